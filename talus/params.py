"""Every threshold in one place. Operators take these as arguments, so a caller can
scale or override them without touching logic."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScreenParams:
    min_market_cap: float = 2_000_000_000
    min_price: float = 5
    min_avg_volume: float = 500_000
    quote_type: str = "EQUITY"
    market: str = "us_market"
    currency: str = "USD"
    exclude_sectors: tuple[str, ...] = ("Financial Services", "Real Estate")
    day_drop: float = -0.20
    month_drop: float = -0.25
    from_high: float = -0.40
    month_prefilter: float = -0.15
    max_month_checks: int = 200
    max_candidates: int = 30
    cooldown_days: int = 14


@dataclass(frozen=True)
class SeriesParams:
    keep_quarters: int = 21
    keep_annual: int = 6
    quarter_days: tuple[int, int] = (80, 100)
    annual_days: tuple[int, int] = (350, 380)


@dataclass(frozen=True)
class SanityParams:
    balance_tolerance: float = 0.02
    revenue_jump: float = 0.5
    max_gap_days: int = 100
    recent_quarters: int = 8
    core_concepts: tuple[str, ...] = ("revenue", "operatingIncome", "cfo", "assets")


@dataclass(frozen=True)
class EconomicsParams:
    discount_rate: float = 0.10
    max_discount_rate: float = 0.16
    marker_step: float = 0.02
    terminal_growth: float = 0.025
    tax_rate: float = 0.21
    fade_years: int = 10
    unprofitable_haircut: float = 0.5
    leverage_marker: float = 1.5
    thin_margin_pct: float = 5.0
    small_cap: float = 5e9
    mega_cap: float = 100e9
    growth_lo: float = -0.9
    growth_hi: float = 1.0
    halvings: int = 60


@dataclass(frozen=True)
class CalibrationParams:
    min_samples: int = 20
    min_samples_per_class: int = 10
    guard_fired_share: float = 0.3
    guard_extra_discount: float = 0.05
    guard_min_graded: int = 10
    min_factor: float = 0.5
    max_factor: float = 1.5


@dataclass(frozen=True)
class GateParams:
    required_discount: float = 0.2
    max_net_debt_to_ebitda: float = 2.5
    accepted_moats: tuple[str, ...] = ("wide", "narrow")
    roic_bypass_margin_pct: float = 15.0
    max_share_cagr_pct: float = 8.0
    min_fcf_positive_share: float = 0.5
    min_fcf_quarters: int = 8
    min_gap_pts: float = 5.0
    street_cap: float = 1.75
    entry_hurdle: float = 0.15


@dataclass(frozen=True)
class MemoryParams:
    downvote_suppress_days: int = 30
    watchlist_days: int = 90
    watchlist_max: int = 5
    news_max_companies: int = 5
    headlines_per_company: int = 4
    fresh_hours: int = 48
    top_n: int = 5
    snippet_chars: int = 300
    last_text_chars: int = 400
    last_reply_chars: int = 600


@dataclass(frozen=True)
class MultiplesParams:
    instant_tolerance_days: int = 135
    close_tolerance_days: int = 46
    min_observations: int = 4


# Industry codes of finance, insurance and real estate, which the screen leaves out.
EXCLUDED_SIC: tuple[tuple[int, int], ...] = ((6000, 6799),)

# Low-signal news sources dropped before anything reads a headline.
BANNED_SOURCES: tuple[str, ...] = (
    "Motley Fool",
    "Zacks",
    "Seeking Alpha",
    "Benzinga",
    "InvestorPlace",
    "Simply Wall St",
    "TipRanks",
    "MarketBeat",
    "StockNews.com",
    "PRNewswire",
    "GlobeNewswire",
    "Accesswire",
)

# Title pattern of routine law-firm notices.
LAW_FIRM_PATTERN = r"class action|investors? rights|law (firm|offices)|deadline alert|lawsuit reminder"

# Phrases that make a falsifier uncheckable, and ones that lean on guidance.
VAGUE_PATTERN = r"sentiment|momentum|investor confidence|market recovers|stock (price )?(recovers|rebounds)"
GUIDANCE_PATTERN = r"guidance|management'?s? (guide|outlook|forecast|target)"

# Listed-ticker spelling.
TICKER_PATTERN = r"^[A-Z]{1,5}(-[A-Z])?$"

# Exhibit file names that carry a press release.
EXHIBIT_PATTERN = r"(ex(hibit)?[\W_]*99|press|earnings\w*release|(^|[^\d])99[-_.]?1)"

# Section headings of periodic reports.
SECTION_START_PATTERN = r"management['’]s\s+discussion\s+and\s+analysis"
SECTION_END_PATTERN = r"quantitative\s+and\s+qualitative\s+disclosures|controls\s+and\s+procedures"

# Concept dictionary. One row per concept: taxonomy, unit, kind, then the tags
# a company may have used for it, best first.
CONCEPTS: tuple[tuple[str, str, str, str, tuple[str, ...]], ...] = (
    ("revenue", "us-gaap", "USD", "duration", (
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet")),
    ("costOfRevenue", "us-gaap", "USD", "duration", (
        "CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices")),
    ("grossProfit", "us-gaap", "USD", "duration", ("GrossProfit",)),
    ("operatingIncome", "us-gaap", "USD", "duration", ("OperatingIncomeLoss",)),
    ("netIncome", "us-gaap", "USD", "duration", ("NetIncomeLoss", "ProfitLoss")),
    ("depreciationAmortization", "us-gaap", "USD", "duration", (
        "DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet",
        "DepreciationAndAmortization")),
    ("cfo", "us-gaap", "USD", "duration", (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    ("capex", "us-gaap", "USD", "duration", (
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
        "PaymentsToAcquirePropertyPlantAndEquipmentAndIntangibleAssets")),
    ("sbc", "us-gaap", "USD", "duration", (
        "ShareBasedCompensation", "AllocatedShareBasedCompensationExpense")),
    ("interestExpense", "us-gaap", "USD", "duration", (
        "InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt")),
    ("cash", "us-gaap", "USD", "instant", (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    ("shortTermInvestments", "us-gaap", "USD", "instant", (
        "ShortTermInvestments", "AvailableForSaleSecuritiesDebtSecuritiesCurrent",
        "MarketableSecuritiesCurrent")),
    ("longTermDebt", "us-gaap", "USD", "instant", (
        "LongTermDebtNoncurrent", "LongTermDebt", "LongTermDebtAndCapitalLeaseObligations")),
    ("currentDebt", "us-gaap", "USD", "instant", (
        "LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings")),
    ("inventory", "us-gaap", "USD", "instant", ("InventoryNet",)),
    ("ppe", "us-gaap", "USD", "instant", (
        "PropertyPlantAndEquipmentNet",
        "PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization")),
    ("assets", "us-gaap", "USD", "instant", ("Assets",)),
    ("liabilities", "us-gaap", "USD", "instant", ("Liabilities",)),
    ("equity", "us-gaap", "USD", "instant", (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    ("sharesOutstanding", "dei", "shares", "instant", ("EntityCommonStockSharesOutstanding",)),
    ("weightedSharesDiluted", "us-gaap", "shares", "duration", (
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfSharesOutstandingBasic")),
)

# Anchor metrics; the first two value the whole enterprise, so net debt comes off.
EV_METRICS = ("EV/EBITDA", "EV/Sales")
EQUITY_METRICS = ("P/E", "P/S", "P/FCF", "P/B")
HORIZONS = ("1", "3")
CASES = ("bear", "base", "bull")


@dataclass(frozen=True)
class Params:
    screen: ScreenParams = field(default_factory=ScreenParams)
    series: SeriesParams = field(default_factory=SeriesParams)
    sanity: SanityParams = field(default_factory=SanityParams)
    economics: EconomicsParams = field(default_factory=EconomicsParams)
    calibration: CalibrationParams = field(default_factory=CalibrationParams)
    gate: GateParams = field(default_factory=GateParams)
    memory: MemoryParams = field(default_factory=MemoryParams)
    multiples: MultiplesParams = field(default_factory=MultiplesParams)


DEFAULTS = Params()
