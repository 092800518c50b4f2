"""Lookup tables, word lists, patterns and thresholds of the domain.

Order matters wherever a comment says "first match wins".
"""

# The seven industry sectors.
SECTORS = ["defense", "finance", "healthcare", "energy", "tech", "agriculture", "telecom"]

# Severity quadrants in reporting order, cuts and risk levels.
QUADRANTS = ["SEVERE", "SYSTEMIC", "OUTLIER", "UNREMARKABLE"]
FLAGGED = ["SEVERE", "SYSTEMIC"]
HIGH_INDEX = 60
AUDIT_INDEX = 70
RISK_LEVELS = {"SEVERE": "very_high", "SYSTEMIC": "high", "OUTLIER": "medium", "UNREMARKABLE": "low"}

# Feature vectors.
FEATURES_V2 = [
    "cohort_alpha", "pre_trade_alpha", "proximity_days", "bill_proximity", "has_proximity_data",
    "committee_relevance", "amount_zscore", "cluster_score", "disclosure_lag",
]
FEATURES_V1 = [
    "cohort_alpha", "proximity_days", "has_proximity_data", "committee_relevance", "disclosure_lag",
]

# Feature windows (days), fallbacks and defaults.
BENCHMARK_TICKER = "SPY"
ALPHA_FORWARD_DAYS = 30
ALPHA_BACKWARD_DAYS = 7
VOTE_CAP_DAYS = 90
BILL_CAP_DAYS = 180
BILL_WINDOW_DAYS = 90
CLUSTER_DAYS = 7
PROXIMITY_FALLBACK = 7
BILL_FALLBACK = 90
DEFAULT_AMOUNT = 8000
MIN_AMOUNT_TRADES = 5
MIN_SHARES_DELTA = 100

# State and territory names.
STATE_ABBREV = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "american samoa": "AS", "guam": "GU",
    "northern mariana islands": "MP", "puerto rico": "PR", "u.s. virgin islands": "VI",
}

# Chamber, office and vote-position spellings.
CHAMBERS = {"house": "House", "senate": "Senate", "joint": "Joint"}
OFFICES = {"H": "House", "S": "Senate"}
VOTE_CASTS = {
    "yea": "yes", "yes": "yes", "aye": "yes", "nay": "no", "no": "no",
    "not voting": "not_voting", "present": "abstain",
}
VOTE_POSITIONS = {"yes": "Yes", "no": "No", "not_voting": "Not Voting", "abstain": "Present"}

# Disclosed amount ranges; first match wins, default first range.
HOUSE_AMOUNTS = [
    (r"\$1,001\s*[-–]\s*\$15,000", 1001, 15000),
    (r"\$15,001\s*[-–]\s*\$50,000", 15001, 50000),
    (r"\$50,001\s*[-–]\s*\$100,000", 50001, 100000),
    (r"\$100,001\s*[-–]\s*\$250,000", 100001, 250000),
    (r"\$250,001\s*[-–]\s*\$500,000", 250001, 500000),
    (r"\$500,001\s*[-–]\s*\$1,000,000", 500001, 1000000),
    (r"\$1,000,001\s*[-–]\s*\$5,000,000", 1000001, 5000000),
    (r"Over\s*\$5,000,000", 5000001, 50000000),
    (r"\$5,000,001\s*[-–]\s*\$25,000,000", 5000001, 25000000),
    (r"\$25,000,001\s*[-–]\s*\$50,000,000", 25000001, 50000000),
]
SENATE_AMOUNTS = HOUSE_AMOUNTS[:7] + [
    (r"\$5,000,001\s*[-–]\s*\$25,000,000", 5000001, 25000000),
    (r"Over\s*\$5,000,000", 5000001, 50000000),
]
FEED_AMOUNTS = [
    (r"(?i)\$1,001 - \$15,000", 1001, 15000),
    (r"(?i)\$15,001 - \$50,000", 15001, 50000),
    (r"(?i)\$50,001 - \$100,000", 50001, 100000),
    (r"(?i)\$100,001 - \$250,000", 100001, 250000),
    (r"(?i)\$250,001 - \$500,000", 250001, 500000),
    (r"(?i)\$500,001 - \$1,000,000", 500001, 1000000),
    (r"(?i)Over \$1,000,000", 1000001, 5000000),
]
DEFAULT_RANGE = (1001, 15000)

# Ticker patterns (letter case ignored) and words that are no tickers.
HOUSE_TICKER = (
    r"(?i)(?:\(([A-Z]{1,5})\))|(?:\[([A-Z]{1,5})\])|(?:ticker:\s*([A-Z]{1,5}))|(?:Stock\s*[-–]\s*([A-Z]{1,5}))"
)
SENATE_TICKER = r"(?i)(?:\(([A-Z]{1,5})\))|(?:\[([A-Z]{1,5})\])|(?:ticker[:\s]+([A-Z]{1,5}))"
NOT_TICKERS = [
    "THE", "AND", "FOR", "INC", "LLC", "LTD", "ETF", "CORP", "CO", "CLASS", "COM", "USD", "NEW",
    "OLD", "FUND", "TRUST", "BOND", "NOTE", "INDEX",
]
ARTIFACT_TICKERS = ["CS", "OT", "ST", "HN", "PS", "CT", "OI"]
NO_TICKER_CELLS = ["--", "—", "N/A", ""]

# Transaction wording; exact first, then first contained key wins.
HOUSE_TRANSACTIONS = {
    "p": "buy", "purchase": "buy", "buy": "buy", "s": "sell", "sale": "sell", "sell": "sell",
    "s (partial)": "sell", "sale (partial)": "sell", "s (full)": "sell", "sale (full)": "sell",
    "e": "exchange", "exchange": "exchange",
}
SENATE_TRANSACTIONS = {
    "purchase": "buy", "buy": "buy", "sale": "sell", "sell": "sell", "sale (full)": "sell",
    "sale (partial)": "sell", "exchange": "exchange",
}
FEED_TRANSACTIONS = {
    "purchase": "buy", "buy": "buy", "sale": "sell", "sell": "sell", "exchange": "exchange",
}
TRADE_TYPES = ["buy", "sell", "exchange"]

# Asset types that are not equity.
SKIPPED_ASSET_TYPES = [
    "municipal bond", "municipal security", "corporate bond", "bank deposit", "real estate",
    "real property", "non-public stock", "private equity",
]

# Company-name fragments; first match wins.
COMPANY_TICKERS = {
    "apple": "AAPL", "microsoft": "MSFT", "amazon": "AMZN", "alphabet": "GOOGL", "google": "GOOGL",
    "meta platform": "META", "facebook": "META", "tesla": "TSLA", "nvidia": "NVDA",
    "starbuck": "SBUX", "jpmorgan": "JPM", "j.p. morgan": "JPM", "bank of america": "BAC",
    "wells fargo": "WFC", "citigroup": "C", "goldman sachs": "GS", "morgan stanley": "MS",
    "johnson & johnson": "JNJ", "johnson and johnson": "JNJ", "procter & gamble": "PG",
    "procter and gamble": "PG", "pfizer": "PFE", "eli lilly": "LLY", "merck": "MRK",
    "abbvie": "ABBV", "unitedhealth": "UNH", "chevron": "CVX", "exxon": "XOM",
    "conocophillips": "COP", "walt disney": "DIS", "disney": "DIS", "netflix": "NFLX", "visa": "V",
    "mastercard": "MA", "coca-cola": "KO", "coca cola": "KO", "pepsi": "PEP", "pepsico": "PEP",
    "boeing": "BA", "lockheed": "LMT", "raytheon": "RTX", "general dynamics": "GD",
    "northrop": "NOC", "caterpillar": "CAT", "deere": "DE", "john deere": "DE", "home depot": "HD",
    "walmart": "WMT", "costco": "COST", "target": "TGT", "salesforce": "CRM", "adobe": "ADBE",
    "intel": "INTC", "amd": "AMD", "advanced micro": "AMD", "broadcom": "AVGO", "qualcomm": "QCOM",
    "cisco": "CSCO", "ibm": "IBM", "oracle": "ORCL", "palantir": "PLTR", "snowflake": "SNOW",
    "uber": "UBER", "airbnb": "ABNB", "coinbase": "COIN", "robinhood": "HOOD", "paypal": "PYPL",
    "at&t": "T", "verizon": "VZ", "t-mobile": "TMUS", "comcast": "CMCSA", "ford": "F",
    "general motors": "GM", "3m": "MMM",
}

# Bill policy area -> sector.
POLICY_AREA_SECTORS = {
    "Armed Forces and National Security": "defense",
    "Defense": "defense",
    "Emergency Management": "defense",
    "Transportation and Public Works": "defense",
    "International Affairs": "defense",
    "Economics and Public Finance": "finance",
    "Finance and Financial Sector": "finance",
    "Taxation": "finance",
    "Housing and Community Development": "finance",
    "Foreign Trade and International Finance": "finance",
    "Labor and Employment": "finance",
    "Health": "healthcare",
    "Social Welfare": "healthcare",
    "Education": "healthcare",
    "Civil Rights and Liberties, Minority Issues": "healthcare",
    "Families": "healthcare",
    "Energy": "energy",
    "Environmental Protection": "energy",
    "Public Lands and Natural Resources": "energy",
    "Water Resources Development": "energy",
    "Science, Technology, Communications": "tech",
    "Commerce": "tech",
    "Agriculture and Food": "agriculture",
    "Animals": "agriculture",
}

# Keyword contained in a committee name -> overseen sectors.
COMMITTEE_KEYWORD_SECTORS = {
    "agriculture": ["agriculture"],
    "armed services": ["defense"],
    "energy": ["energy"],
    "natural resources": ["energy", "agriculture"],
    "commerce": ["tech", "telecom"],
    "financial": ["finance"],
    "banking": ["finance"],
    "finance": ["finance", "healthcare"],
    "health": ["healthcare"],
    "veterans": ["healthcare"],
    "science": ["tech"],
    "homeland": ["defense", "tech"],
    "ways and means": ["finance", "healthcare"],
    "education": ["healthcare"],
    "transportation": ["defense"],
}
# Cross-cutting committees (first match wins) and seat weights.
CROSS_CUTTING_KEYWORDS = {
    "intelligence": (0.5, ["defense", "tech"]),
    "appropriations": (0.4, SECTORS),
}
MEMBER_WEIGHT = 0.7
LEADER_WEIGHT = 1.0
CROSS_LEADER_FACTOR = 1.3

# Exact committee names -> sectors (version 1 features).
COMMITTEE_NAME_SECTORS = {
    "House Committee on Agriculture": ["agriculture"],
    "House Committee on Armed Services": ["defense"],
    "House Committee on Energy and Commerce": ["energy", "healthcare", "tech", "telecom"],
    "House Committee on Financial Services": ["finance"],
    "Senate Committee on Agriculture, Nutrition, and Forestry": ["agriculture"],
    "Senate Committee on Armed Services": ["defense"],
    "Senate Committee on Banking, Housing, and Urban Affairs": ["finance"],
    "Senate Committee on Commerce, Science, and Transportation": ["tech", "telecom"],
    "Senate Committee on Energy and Natural Resources": ["energy"],
    "Senate Committee on Finance": ["finance", "healthcare"],
    "Senate Committee on Health, Education, Labor, and Pensions": ["healthcare"],
    "House Committee on Science, Space, and Technology": ["tech"],
    "House Committee on Natural Resources": ["energy", "agriculture"],
    "House Committee on Transportation and Infrastructure": ["defense"],
    "Senate Committee on Environment and Public Works": ["energy"],
    "House Committee on Veterans' Affairs": ["healthcare"],
    "Senate Committee on Veterans' Affairs": ["healthcare"],
    "House Committee on Ways and Means": ["finance", "healthcare"],
    "House Committee on Education and the Workforce": ["healthcare"],
    "House Committee on Homeland Security": ["defense", "tech"],
    "Senate Committee on Homeland Security and Governmental Affairs": ["defense", "tech"],
}
CROSS_CUTTING_NAMES = {
    "House Permanent Select Committee on Intelligence": (0.5, ["defense", "tech"]),
    "Senate Select Committee on Intelligence": (0.5, ["defense", "tech"]),
    "House Committee on Appropriations": (0.4, SECTORS),
    "Senate Committee on Appropriations": (0.4, SECTORS),
}

# Committee-name keywords -> one sector tag; first match wins, sector by sector.
COMMITTEE_TAG_KEYWORDS = [
    ("defense", [
        "Armed Services", "Veterans' Affairs", "Homeland Security", "Foreign Affairs",
        "Foreign Relations", "Intelligence", "Military", "Seapower", "Strategic Forces",
        "Tactical Air", "Readiness", "Airland", "Coast Guard", "Counterterrorism",
        "Border Security", "National Security", "Emerging Threats", "Maritime Security",
        "State Department", "Transportation", "Aviation", "Highway", "Defense",
    ]),
    ("finance", [
        "Financial Services", "Financial Institutions", "Capital Markets", "Digital Assets",
        "Securities", "Insurance", "Ways and Means", "Taxation", "Social Security", "Pension",
        "Small Business", "Antitrust", "Housing", "Banking", "Finance", "Fiscal", "Economic", "Tax",
        "Trade",
    ]),
    ("healthcare", [
        "Health", "Aging", "Disability", "Early Childhood", "Welfare", "Education", "Employment",
        "Workforce",
    ]),
    ("energy", [
        "Energy and Commerce", "Energy and Natural Resources", "Environment and Public Works",
        "Chemical Safety", "Clean Air", "Climate", "Nuclear", "Pipeline", "Mining", "Public Lands",
        "National Parks", "Federal Lands", "Interior", "Mineral", "Natural Resources", "Energy",
        "Environment", "Water",
    ]),
    ("tech", [
        "Science, Space, and Technology", "Commerce, Science, and Transportation", "Cybersecurity",
        "Artificial Intelligence", "Intellectual Property", "Space and Aeronautics",
        "Research and Technology", "Privacy", "Modernization", "Cyber", "Innovation", "Technology",
        "Science", "Commerce",
    ]),
    ("telecom", ["Telecommunications", "Communications"]),
    ("agriculture", [
        "Agriculture", "Nutrition", "Rural Development", "Forestry", "Livestock", "Dairy", "Poultry",
        "Farm", "Horticulture", "Conservation", "Fisheries",
    ]),
]

# Employer keywords -> sector; first match wins, sector by sector.
EMPLOYER_KEYWORDS = [
    ("defense", [
        "defense", "military", "lockheed", "raytheon", "northrop", "boeing", "general dynamics",
        "l3harris", "bae systems",
    ]),
    ("finance", [
        "bank", "capital", "financ", "invest", "insurance", "credit", "goldman", "morgan",
        "jpmorgan", "citigroup", "fidelity", "blackrock", "securities", "hedge", "asset management",
        "wells fargo",
    ]),
    ("healthcare", [
        "health", "pharma", "medical", "hospital", "biotech", "pfizer", "johnson & johnson", "merck",
        "abbott", "unitedhealth", "humana", "anthem", "cigna", "aetna",
    ]),
    ("energy", [
        "energy", "oil", "gas", "petroleum", "exxon", "chevron", "solar", "electric", "utility",
        "power", "mining", "coal", "nuclear",
    ]),
    ("tech", [
        "tech", "software", "google", "microsoft", "apple", "amazon", "meta", "nvidia", "intel",
        "cisco", "oracle", "ibm", "semiconductor", "cyber", "data", "cloud", "ai ",
        "artificial intelligence",
    ]),
    ("telecom", [
        "telecom", "media", "broadcast", "comcast", "verizon", "at&t", "disney", "netflix",
        "entertainment", "communications",
    ]),
    ("agriculture", [
        "farm", "agri", "food", "beverage", "restaurant", "retail", "grocery", "consumer", "tobacco",
        "alcohol", "wine", "beer",
    ]),
]

# Tickers that belong to several sectors (override the base map).
MULTI_SECTOR_TICKERS = {
    "MSFT": ["tech", "defense"], "AMZN": ["tech", "telecom"], "GOOG": ["tech", "telecom"],
    "GOOGL": ["tech", "telecom"], "META": ["tech", "telecom"],
    "GE": ["defense", "energy", "healthcare"], "HON": ["defense", "tech", "energy"],
    "MMM": ["defense", "healthcare"], "UNH": ["healthcare", "finance"], "VZ": ["telecom", "tech"],
    "T": ["telecom", "tech"], "CRM": ["tech", "defense"], "ORCL": ["tech", "defense"],
    "IBM": ["tech", "defense"], "INTC": ["tech", "defense"], "PLTR": ["tech", "defense"],
    "LHX": ["defense", "tech"], "CSCO": ["tech", "telecom", "defense"], "ACN": ["tech", "defense"],
    "ABT": ["healthcare", "tech"], "MDT": ["healthcare", "tech"], "TMO": ["healthcare", "tech"],
    "DHR": ["healthcare", "tech"], "SYK": ["healthcare", "tech"], "BDX": ["healthcare", "tech"],
    "CI": ["healthcare", "finance"], "HUM": ["healthcare", "finance"],
    "AIG": ["finance", "healthcare"], "BRK.B": ["finance", "energy", "defense"],
    "DUK": ["energy", "tech"], "NEE": ["energy", "tech"], "QCOM": ["tech", "telecom", "defense"],
    "AVGO": ["tech", "telecom"],
}

# Fund tickers added to the base map only where missing.
FUND_TICKERS = {
    "SHY": "finance", "IEF": "finance", "TLT": "finance", "SGOV": "finance", "BIL": "finance",
    "TBLL": "finance", "USFR": "finance", "TFLO": "finance", "VGSH": "finance", "SHV": "finance",
    "SCHO": "finance", "FLOT": "finance", "GOVT": "finance", "VMBS": "finance", "MBB": "finance",
    "JMBS": "finance", "AGG": "finance", "BND": "finance", "BNDX": "finance", "SCHZ": "finance",
    "VCSH": "finance", "VCIT": "finance", "LQD": "finance", "HYG": "finance", "JNK": "finance",
    "MINT": "finance", "NEAR": "finance", "JPST": "finance", "GBIL": "finance", "CARY": "finance",
    "ICSH": "finance", "FLRN": "finance", "JAAA": "finance", "CLOA": "finance", "SRLN": "finance",
    "BKLN": "finance", "TLH": "finance", "SCHP": "finance", "AGZ": "finance", "CMBS": "finance",
    "GIGB": "finance", "PIMCO": "finance",
    "SPY": "finance", "IVV": "finance", "VOO": "finance", "VTI": "finance", "ITOT": "finance",
    "SCHB": "finance", "SPTM": "finance", "IVW": "finance", "IVE": "finance", "QQQ": "tech",
    "QQQM": "tech", "VGT": "tech", "XLK": "tech", "IWM": "finance", "IWF": "finance",
    "IWD": "finance", "MDY": "finance", "IJR": "finance", "IJH": "finance", "TNA": "finance",
    "TZA": "finance", "ARKK": "tech", "ARKW": "tech", "ARKG": "healthcare", "ARKF": "finance",
    "BITB": "finance", "IBIT": "finance", "FBTC": "finance", "GBTC": "finance", "ETHE": "finance",
    "BITO": "finance",
    "XLE": "energy", "VDE": "energy", "IEO": "energy", "OIH": "energy", "AMLP": "energy",
    "EMLP": "energy", "USO": "energy", "UNG": "energy", "XOP": "energy", "FCG": "energy",
    "TPYP": "energy",
    "SLV": "finance", "GLD": "finance", "IAU": "finance", "PALL": "energy", "PPLT": "energy",
    "FTGC": "energy", "DBC": "energy", "PDBC": "energy", "GSG": "energy",
    "XLV": "healthcare", "VHT": "healthcare", "IBB": "healthcare", "XBI": "healthcare",
    "IHI": "healthcare",
    "ITA": "defense", "PPA": "defense", "XAR": "defense", "DFEN": "defense",
    "DBA": "agriculture", "MOO": "agriculture", "VEGI": "agriculture",
    "IYZ": "telecom", "VOX": "telecom", "XLC": "telecom", "FCOM": "telecom",
    "XLF": "finance", "VFH": "finance", "KBE": "finance", "KRE": "finance", "IAI": "finance",
    "VNQ": "finance", "SCHH": "finance", "IYR": "finance", "VNQI": "finance",
    "XLU": "energy", "VPU": "energy",
    "EFA": "finance", "VEA": "finance", "IEFA": "finance", "VWO": "finance", "EEM": "finance",
    "SCHE": "finance", "IEMG": "finance", "GEM": "finance", "SMCY": "finance",
    "VYM": "finance", "SCHD": "finance", "DVY": "finance", "HDV": "finance", "JEPI": "finance",
    "JEPQ": "finance", "DIVO": "finance",
    "STX": "tech", "CHRW": "finance", "RS": "defense",
}

# Ticker -> sector of the third-party feed.
FEED_TICKERS = {
    "LMT": "defense", "RTX": "defense", "BA": "defense", "NOC": "defense", "GD": "defense",
    "HII": "defense", "LHX": "defense", "JPM": "finance", "GS": "finance", "BAC": "finance",
    "WFC": "finance", "C": "finance", "MS": "finance", "BLK": "finance", "SCHW": "finance",
    "UNH": "healthcare", "CVS": "healthcare", "PFE": "healthcare", "JNJ": "healthcare",
    "MRK": "healthcare", "ABBV": "healthcare", "LLY": "healthcare", "TMO": "healthcare",
    "ABT": "healthcare", "XOM": "energy", "CVX": "energy", "COP": "energy", "SLB": "energy",
    "EOG": "energy", "OXY": "energy", "MPC": "energy", "PSX": "energy", "AAPL": "tech",
    "MSFT": "tech", "GOOGL": "tech", "GOOG": "tech", "NVDA": "tech", "META": "tech",
    "AMZN": "tech", "TSLA": "tech", "CRM": "tech", "ORCL": "tech", "AVGO": "tech", "AMD": "tech",
    "INTC": "tech", "CSCO": "tech", "ADBE": "tech", "T": "telecom", "VZ": "telecom",
    "TMUS": "telecom", "ADM": "agriculture", "DE": "agriculture", "MOS": "agriculture",
}

# Tracked institutional funds, key -> short name.
TRACKED_FUNDS = {
    "102909": "Vanguard", "93751": "StateStreet", "315066": "Fidelity", "1037389": "Berkshire",
    "1061768": "Renaissance", "1038133": "TRowePrice", "1364742": "BlackRock", "1350694": "Citadel",
    "1336528": "Bridgewater", "1535392": "TwoSigma",
}

# Spellings of names that no rule resolves -> person key.
NAME_ALIASES = {
    "thomas h tuberville": "T000278", "rob bresnahan": "B001327", "valerie hoyle": "H001094",
    "richard w. allen": "A000372", "daniel s sullivan": "S001198", "patrick fallon": "F000246",
    "marjorie taylor mrs greene": "G000596", "mark dr green": "G000590",
    "donald sternoff beyer": "B001292", "ritchie john torres": "T000486",
    "shelley m capito": "C001047", "john w hickenlooper": "H001042", "victoria spartz": "S001199",
    "gilbert cisneros": "C001123", "daniel goldman": "G000599", "jerry moran,": "M000934",
    "angus s king, jr.": "K000383", "a. mitchell mcconnell, jr.": "M000355",
    "william f hagerty, iv": "H000601", "michael c. burgess": "B001248",
    "thomas suozzi": "S001201", "john curtis": "C001114", "jonathan jackson": "J000308",
}

# Bill reference in a vote title, its type spellings, and web address parts.
BILL_REFERENCE = (
    r"(?i)(?:^|[\s:])(S\.|H\.R\.|S\.J\.Res\.|H\.J\.Res\.|S\.Con\.Res\.|H\.Con\.Res\.|H\.Res\.|S\.Res\.)\s*(\d+)"
)
BILL_TYPES = {
    "s.": "s", "h.r.": "hr", "s.j.res.": "sjres", "h.j.res.": "hjres", "s.con.res.": "sconres",
    "h.con.res.": "hconres", "h.res.": "hres", "s.res.": "sres",
}
PACKAGE_ID = r"(?i)^BILLS-(\d+)([a-z]+?)(\d+)([a-z]+)$"
BILL_SLUGS = {
    "hr": "house-bill", "s": "senate-bill", "hjres": "house-joint-resolution",
    "sjres": "senate-joint-resolution",
}
BILL_LINK = (
    r"(?i)\b(H\.?\s*R\.?\s*\d+|S\.?\s*\d+|H\.?\s*Res\.?\s*\d+|S\.?\s*Res\.?\s*\d+"
    r"|H\.?\s*Con\.?\s*Res\.?\s*\d+|S\.?\s*Con\.?\s*Res\.?\s*\d+)\b"
)
FILING_URL = "https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/"
BILL_URL = "https://www.congress.gov/bill/119th-congress/"
