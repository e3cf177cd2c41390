"""Fixed word lists and constants of the published methods.

Sentiment: Hutto & Gilbert 2014. The valence lexicon itself is an input table.
"""

# -- fixed values: sentiment rules ------------------------------------------------------------

BOOST = 0.293
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin",
    "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully", "fuckin",
    "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible",
    "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally",
    "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce",
    "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of",
)  # two words: looked up as a pair
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't",
    "mightn't", "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing",
    "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't",
    "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't",
    "rarely", "seldom", "despite",
)
NEGATION_FACTOR = -0.74
# "never so good" and "never this good" praise, "without doubt good" is plain, "least good" denies,
# but "at least good" and "very least good" do not.
NEVER, NEVER_FOLLOWED, NEVER_FACTOR = "never", ("so", "this"), 1.25
WITHOUT, WITHOUT_FOLLOWED = "without", ("doubt",)
LEAST, LEAST_AFTER = "least", ("at", "very")
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
CAPS_INCREMENT = 0.733
EXCLAMATION = 0.292
MAX_EXCLAMATIONS = 4
QUESTION = 0.18
MANY_QUESTIONS = 0.96
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
COMPOUND_ALPHA = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# -- fixed values: term counting --------------------------------------------------------------

WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
LLR_THRESHOLD = 30.0
TOP_TERMS = 200
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "can't", "cannot", "com", "could", "couldn't", "did", "didn't",
    "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "else", "ever", "few",
    "for", "from", "further", "get", "had", "hadn't", "has", "hasn't", "have", "haven't",
    "having", "he", "he'd", "he'll", "he's", "hence", "her", "here", "here's", "hers", "herself",
    "him", "himself", "his", "how", "how's", "however", "http", "i", "i'd", "i'll", "i'm",
    "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "just", "k",
    "let's", "like", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of",
    "off", "on", "once", "only", "or", "other", "otherwise", "ought", "our", "ours", "ourselves",
    "out", "over", "own", "r", "same", "shall", "shan't", "she", "she'd", "she'll", "she's",
    "should", "shouldn't", "since", "so", "some", "such", "than", "that", "that's", "the",
    "their", "theirs", "them", "themselves", "then", "there", "there's", "therefore", "these",
    "they", "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've",
    "were", "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while",
    "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't", "www", "you",
    "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves",
)
