"""The tags, markers, prefixes, patterns and formula constants
that every result depends on. They are stated once, here."""

# Tags of the linearised form of a triple.
START = "<SOT>"
END = "<EOT>"
SUBJECT = "<SUBJ>"
PREDICATE = "<PRED>"
OBJECT = "<OBJ>"

# Marker appended to the input of each task.
TASK_MARKERS = {
    "text2rdf": "<Text2RDF>",
    "rdf2text": "<RDF2Text>",
    "rdfcomp2": "<CONTINUERDF>",
    "rdfcomp1": "<MASK>",
}
MASK = "<MASK>"
TASKS = ("text2rdf", "rdf2text", "rdfcomp1", "rdfcomp2")
SPLITS = ("train", "val", "test")

# IRI prefixes and their short forms.
IRI_PREFIXES = {
    "http://dbpedia.org/resource/": "dbr:",
    "http://dbpedia.org/ontology/": "dbo:",
}
RESOURCE_PREFIXES = ("http://dbpedia.org/resource/", "https://dbpedia.org/resource/")
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

# Predicates kept by default when the neighbourhood of an entity is extracted.
DEFAULT_PREDICATES = (
    "dbo:director",
    "dbo:starring",
    "dbo:writer",
    "dbo:musicComposer",
    "dbo:releaseDate",
    "dbo:runtime",
    "dbo:country",
    "dbo:language",
    "dbo:genre",
)

# Start of an entity mention inside a text.
MENTION = r"(?:dbr:|dbo:|dbc:|dbp:|http://|https://)"

# Special tokens of the vocabulary, in id order.
UNKNOWN = "<unk>"
PAD = "<pad>"
SPECIAL_TOKENS = (
    "<unk>",
    "<pad>",
    "<SOT>",
    "<EOT>",
    "<SUBJ>",
    "<PRED>",
    "<OBJ>",
    "<RDF2Text>",
    "<Text2RDF>",
    "<CONTINUERDF>",
    "<MASK>",
)

# Defaults of the dataset build.
MIN_TRIPLES = 3
SPLIT_RATIOS = (0.8, 0.1, 0.1)
SPLIT_SEED = 13
VOCAB_SIZE = 24000
MIN_FREQUENCY = 2
TASK_WEIGHTS = {"rdf2text": 3, "text2rdf": 3, "rdfcomp1": 2, "rdfcomp2": 2}

# Metric constants.
BLEU_ORDER = 4
BLEU_SMOOTH = 1e-9
ROUGE_BETA = 1.2
METEOR_ALPHA = 0.9
METEOR_BETA = 3.0
METEOR_GAMMA = 0.5

# White space as str.split() and str.strip() of Python see it: that of Unicode
# and four separators.
BLANK = r"(?U:[\s\x1c-\x1f])"
NOT_BLANK = r"(?U:[^\s\x1c-\x1f])"
# The same characters, one by one.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Runs of word characters, and runs of other visible characters (Unicode).
PRETOKEN = r"(?U:\w+|[^\w\s]+)"
# One character of either kind.
WORD_CHARACTER = r"(?U:\w)"
SYMBOL_CHARACTER = r"(?U:[^\w\s])"
