"""Thresholds, lookbacks and word lists. Results depend on every one of them."""

from __future__ import annotations

# Columns of a price panel.
PRICES = ("open", "high", "low", "close")
BAR = (*PRICES, "volume")

# Horizons in sessions: of outcomes (event studies) and of training labels.
OUTCOME_HORIZONS = (1, 5, 20, 60, 126, 252)
LABEL_HORIZONS = (1, 5, 21, 63, 126, 252)
EXPLORATORY_HORIZONS = (60, 126, 252)

# Bar validation.
MIN_PRICE = 0.01
OUTLIER_WINDOW, OUTLIER_MIN, OUTLIER_RATIO = 21, 11, 10.0
GAP_DAYS = 10

# Adjustment seams.
SEAM_GAP, SEAM_SESSIONS, SEAM_LOG_TOLERANCE = 1.30, 10, 1.25

# Evidence gates: events, tickers, overlapping dates; false-discovery rate.
MIN_EVENTS, MIN_TICKERS, MIN_OVERLAP = 30, 5, 15
FDR_Q = 0.10
ADEQUATE_EVENTS, EXPLORATORY_EVENTS, MIN_OTHER_DATES, SHRINK_TICKERS = 20, 8, 10, 20
Z95 = 1.96

# Rolling windows.
WINDOW_DAYS, CATEGORY_STRIDE, TICKER_STRIDE = 365, 91, 182
ROLL_EVENTS, ROLL_TICKERS, ROLL_TICKER_EVENTS, ROLL_TICKER_MIN, TREND_WINDOWS = 30, 10, 8, 4, 4
STRENGTHEN, WEAKEN = 1.25, 0.75

# Backtest and training.
ENTRY, EXIT, COST_BPS = 0.55, 0.50, 10.0
FOLDS, EMBARGO = 5, 10

OTHER = "OTHER"
CATEGORIES = ("EARNINGS_RESULTS", "ANALYST_ACTION", "M_AND_A", "REGULATORY_LEGAL", "MANAGEMENT", "MAJOR_COMPANY_NEWS", OTHER)

# Sessions that a seam stays in each indicator.
LOOKBACK = {
    "ret_1d": 2, "ret_5d": 6, "ret_21d": 22, "vol_21d": 22, "vol_63d": 64, "rsi_14": 64, "macd": 62, "macd_signal": 82,
    "macd_hist": 82, "sma_20": 20, "sma_50": 50, "sma_ratio_20_50": 50, "bb_zscore_20": 20, "atr_14": 15, "volume_zscore_21": 21,
    "obv_delta_5d": 6, "day_of_week": 1, "close_to_sma20": 20, "close_to_sma50": 50, "macd_norm": 62, "macd_signal_norm": 82,
    "macd_hist_norm": 82, "atr_pct": 15, "obv_delta_norm": 22,
}
SCALE_DEPENDENT = ("sma_20", "sma_50", "macd", "macd_signal", "macd_hist", "atr_14", "obv_delta_5d")
NEWS_FEATURES = ("mean_sentiment", "positive_ratio", "negative_ratio", "neutral_ratio", "article_count")

# Seams and entity hand-overs of the historical archive.
SEAMS = (
    ("fnspid", None, "2020-07-06"), ("fnspid", "NEE", "2020-04-02"), ("fnspid", "NDAQ", "2020-04-02"),
    ("fnspid", "EW", "2020-04-02"), ("fnspid", "ETN", "2019-08-15"), ("fnspid", "MO", "2008-03-31"),
)
ENTITY_START = (("IR", "2020-03-02"), ("COR", "2023-08-30"), ("CARR", "2020-04-03"), ("DOW", "2019-04-01"), ("FOXA", "2019-03-19"), ("FOX", "2019-03-19"))
FORCED_CANDIDATES = (("BR", "MANAGEMENT", 20), ("BEN", "MAJOR_COMPANY_NEWS", 1))

# Sentiment lexicon.
POSITIVE = (
    "beat", "beats", "beating", "record", "growth", "surge", "surges", "surged", "gain", "gains", "rally", "rallies", "upgrade",
    "upgraded", "outperform", "strong", "strength", "profit", "profits", "rose", "rises", "rising", "jump", "jumps", "soar", "soars",
    "tops", "exceeds", "bullish", "optimistic", "buy", "dividend", "expansion", "breakthrough", "approval", "wins", "success",
)
NEGATIVE = (
    "miss", "misses", "missed", "drop", "drops", "dropped", "fall", "falls", "fell", "plunge", "plunges", "slump", "slumps",
    "downgrade", "downgraded", "underperform", "weak", "weakness", "loss", "losses", "decline", "declines", "bearish", "pessimistic",
    "sell", "lawsuit", "probe", "investigation", "recall", "bankruptcy", "cut", "cuts", "warns", "warning", "fraud", "layoffs",
)

# Headline rules, in order of priority: the first pattern that matches names the category.
HEADLINE_RULES = (
    ("ANALYST_ACTION", r"\b(?:maintains?|reiterat(?:es?|ed)|initiat(?:es?|ed)\s+coverage|resum(?:es?|ed)\s+coverage|upgrad(?:es?|ed)|downgrad(?:es?|ed)|outperform|underperform|overweight|underweight|price\s+target|target\s+price|buy\s+rating|sell\s+rating|hold\s+rating|neutral\s+rating|recommendation)\b"),
    ("EARNINGS_RESULTS", r"\b(?:earnings|eps|revenues?|profits?|q[1-4]\s*(?:'?\d{2})?|(?:first|second|third|fourth)[\s-]quarter|quarterly\s+results?|beats?|miss(?:es|ed)?|estimates?|guidance|outlook\s+rais|top(?:s|ped)?\s+(?:estimates|views?|expectations)|conference\s+call)\b"),
    ("M_AND_A", r"\b(?:acquir(?:e|es|ed|ing)|acquisitions?|merger|merges?|merging|buyout|takeover|take[\s-]private|tender\s+offer|divestiture|spin[\s-]?off|(?:majority|controlling|minority)\s+stake|bid(?:s)?\s+for|agree[sd]?\s+to\s+(?:buy|acquire)|all[\s-]cash\s+deal|definitive\s+agreement)\b"),
    ("REGULATORY_LEGAL", r"\b(?:lawsuit|sue[sd]?|suing|litigation|settle(?:s|d|ment)?|antitrust|monopol(?:y|ies)|court|judge|jury|trial|appeal|subpoena|indict(?:ed|ment)?|fraud|probe[sd]?|investigat(?:es?|ed|ion)|inquiry|regulator[sy]?|regulation|sanction(?:s|ed)?|penalt(?:y|ies)|fda|ftc|doj|sec\s+(?:filing|probe|charges?|investigation)|securities\s+and\s+exchange|european\s+commission|(?:fda|regulatory|antitrust|eu)\s+(?:approval|clearance|nod)|approved\s+by\s+(?:the\s+)?(?:fda|regulators?)|patent\s+(?:suit|dispute|infringement))\b"),
    ("MANAGEMENT", r"\b(?:ceo|cfo|coo|cto|cio|chief\s+(?:executive|financial|operating|technology|information|legal|medical|revenue)\s+officer|chairman|chairwoman|chair\b|president|executive|exec\b|board\s+(?:member|seat|of\s+directors)|appoint(?:s|ed|ment)?|names?\s+\w+\s+as|steps?\s+down|resign(?:s|ed|ation)?|retir(?:es?|ed|ement)|our?st(?:s|ed)|fir(?:es|ed|ing)|succeed(?:s|ed)|successor|insider\s+(?:buying|selling|sale|purchase))\b"),
    ("MAJOR_COMPANY_NEWS", r"\b(?:unveil(?:s|ed|ing)?|launch(?:es|ed|ing)?|introduc(?:es?|ed|ing)\s+(?:new|a\s+new)|debuts?|roll(?:s|ed)\s+out|partnership|partners\s+with|collaborat(?:es?|ed|ion)|joint\s+venture|(?:expand(?:s|ed|ing)?|boost(?:s|ed|ing)?|bolsters?)\s+(?:its\s+|their\s+|the\s+)?(?:portfolio|offerings?|lineup|capacity|segment|business|presence|footprint|product)|contract\s+(?:win|award)|wins?\s+(?:a\s+)?contract|recall(?:s|ed)?|layoffs?|restructur(?:es?|ing)|buyback|share\s+repurchase|stock\s+split|dividend\s+(?:hike|increase|cut|boost|rais)|(?:rais(?:es?|ed)|hikes?|cuts?)\s+(?:its\s+)?dividend|breakthrough)\b"),
)
