"""Word lists and patterns that results depend on. Fixed values, as text in natural order."""

# Capital words that are no tickers.
NO_TICKERS = """
A I AM AN AS AT BE BY DO GO HE IF IN IS IT ME MY NO OF ON OR SO TO UP US WE ARE BUT CAN DID FOR GET GOT HAS HAD HER HIM HIS HOW ITS LET
MAY NEW NOT NOW OLD OUR OUT OWN RAN SAY SHE THE TOO USE WAS WAY WHO WHY ALL AND ANY BIG DAY END FAR FEW GOD HIT LOW MAN ONE PUT RUN SET
TRY TWO YET CEO CFO SEC FED GDP IPO ETF NYSE ALSO BACK BEEN CALL CAME COME EACH EVEN FIND FIVE FROM GIVE GOOD HAVE HERE HIGH INTO JUST
KEEP KNOW LAST LIKE LONG LOOK MADE MAKE MANY MORE MOST MUCH MUST NAME NEXT ONLY OVER PART SAID SAME SHOW SIDE SOME SUCH SURE TAKE TELL
THAN THAT THEM THEN THEY THIS TIME VERY WANT WELL WENT WERE WHAT WHEN WILL WITH WORD WORK YEAR YOUR ZERO DOWN MOVE REAL RISE SELL GAIN
LOSS BULL BEAR DATA OPEN CLOSE
""".split()

# Sentiment of words.
SENTIMENT = {
    w: float(v) for w, v in (x.split(":") for x in """
buy:0.6 bullish:0.8 surge:0.7 rally:0.7 gain:0.5 profit:0.5 growth:0.5 strong:0.4 beat:0.5 upgrade:0.6 outperform:0.6 positive:0.4 up:0.3
rise:0.4 rising:0.4 high:0.3 record:0.4 boom:0.6 soar:0.7 jump:0.5 increase:0.4 opportunity:0.4 momentum:0.4 breakout:0.5 recover:0.4
recovery:0.4 optimistic:0.5 confident:0.4 exceed:0.4 exceeded:0.4 revenue:0.2 earnings:0.2
sell:-0.6 bearish:-0.8 crash:-0.8 decline:-0.5 loss:-0.5 drop:-0.5 fall:-0.4 falling:-0.4 weak:-0.4 miss:-0.5 downgrade:-0.6 negative:-0.4
down:-0.3 low:-0.3 risk:-0.3 fear:-0.5 plunge:-0.7 tumble:-0.6 slump:-0.6 cut:-0.3 decrease:-0.4 concern:-0.3 warning:-0.4 recession:-0.6
bankruptcy:-0.8 default:-0.7 debt:-0.2 layoff:-0.5 layoffs:-0.5 lawsuit:-0.4 fraud:-0.7 investigation:-0.4
""".split())
}

# Words that hedge, are technical, or are hype.
HEDGING = """may might could possibly perhaps likely unlikely suggest suggests indicate indicates appear appears seem seems approximately roughly
estimate uncertain potential probable tentative preliminary""".split()
TECHNICAL = """equation theorem proof lemma corollary hypothesis derivative integral convergence eigenvalue matrix vector tensor gradient optimization
algorithm variance correlation regression distribution stochastic differential partial boundary nonlinear linear coefficient parameter variable
function operator spectrum frequency amplitude phase resonance bifurcation stability perturbation asymptotic""".split()
HYPE = """incredible amazing revolutionary breakthrough game-changing disruptive explosive skyrocket moon unstoppable guaranteed massive insane
unbelievable unprecedented soaring plummeting crash surge rocket pump dump fomo hodl yolo bullish bearish mooning""".split()
GUIDANCE = "expect guide target anticipate forecast outlook project estimate".split()
FILING_TYPES = ["10-K", "10-Q", "8-K", "13F", "S-1", "DEF 14A", "424B"]

# Source profiles by host, in the order in which they are tried: (host part, parser).
SOURCES = [("arxiv.org", "academic"), ("sec.gov", "filing"), ("reuters.com", "news"), ("ft.com", "news"), ("seekingalpha.com", "transcript"), ("motleyfool.com", "transcript"), ("finviz.com", "social")]

# Source profiles in the order in which they are tried: (domain, fetcher, seconds to wait, parser, adaptive, needs scripts).
PROFILES = [
    ("arxiv.org", "Fetcher", 1.5, "academic", True, False),
    ("sec.gov", "Fetcher", 1.0, "filing", True, False),
    ("reuters.com", "StealthyFetcher", 2.0, "news", True, False),
    ("ft.com", "StealthyFetcher", 2.0, "news", True, False),
    ("seekingalpha.com", "DynamicFetcher", 3.0, "transcript", True, True),
    ("motleyfool.com", "DynamicFetcher", 3.0, "transcript", True, True),
    ("finviz.com", "StealthyFetcher", 1.5, "social", False, False),
]

# Files that tell how a project is built, and names of files to read first (a pattern).
PROJECT_FILES = ["requirements.txt", "setup.py", "pyproject.toml", "Cargo.toml", "package.json", "go.mod", "CMakeLists.txt"]
KEY_FILES = r"^(README|setup\.py$|pyproject\.toml$|package\.json$|main\.py$|index\.js$|app\.py$|CMakeLists\.txt$|Makefile$)"

# Subject fields by words in a URL or title, in the order in which they are tried.
SUBJECTS = [("ece", ["circuit", "electronic", "vlsi", "semiconductor"]), ("biology", ["biology", "neuron", "synapse", "cell"]), ("finance", ["finance", "market", "trading", "economics"]), ("physics", ["physics", "mechanics", "quantum"])]

# LaTeX environments that hold equations.
EQUATION_ENVIRONMENTS = ["equation", "align", "eqnarray", "multline", "gather"]
