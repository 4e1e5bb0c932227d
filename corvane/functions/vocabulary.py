"""Word lists and patterns that decide results."""

# Words that carry no content.
STOPWORDS = frozenset(
    """
    a about an and are as at be by did do does for from how in is it of on or that the this to was what when where which who
    why with me tell
    ale al care ce cine cu cum de din este la pe pentru și sunt unde
    bir bu da için ile kim mı mi mu mü nasıl ne nerede ve
    """.split()
)

# Terms that count as another one.
SYNONYMS = {"capability": "function", "feature": "function", "objective": "goal", "progression": "progress"}

# Words of a question that are no evidence; attributes are none in questions for an attribute.
META_TERMS = frozenset(
    "about according answer describe document documents explain did do does give information me provided say says tell".split()
)
ATTRIBUTE_TERMS = frozenset("color colour size shape date".split())

# Words that ask for a list or a section.
LIST_TERMS = frozenset(
    """
    chapter chapters content contents covered curriculum capability capabilities feature features function functions
    include included includes leaderboard leaderboards list module modules outcome outcomes priority priorities
    section sections step steps subject subjects syllabus technique techniques topic topics unit units
    advantage advantages benefit benefits comparison compare cons difference differences disadvantage disadvantages
    limitation limitations pros strength strengths weakness weaknesses
    """.split()
)
COMPARISON_TERMS = frozenset("compare comparison difference differences".split())

# Phrases by which a sentence defines something, and those that leave no doubt.
DEFINITION_PHRASES = (" is ", " are ", " means ", " refers to ", " includes ", " include ", " consists of ", " is defined as ", " are defined as ", " also known as ")
STRONG_DEFINITION_PHRASES = (" means ", " refers to ", " includes ", " include ", " consists of ", " is defined as ", " are defined as ", " also known as ")
ATTRIBUTE_PHRASES = (" is ", " are ", " was ", " were ", " color is ", " colour is ")

# Patterns; they mean the same to Python's and Java's engines and to RE2 (case ignored where a name ends in _CI).
TOKEN = r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"
ATTRIBUTE_QUESTION_CI = r"^\s*(?:what\s+(?:colou?r|size|shape|date)\s+(?:is|are)|what\s+(?:is|are)\s+the\s+(?:colou?r|size|shape|date)\s+of)\b"
DEFINITION_QUESTION_CI = r"^\s*(?:what\s+(?:is|are)|define|give\s+(?:the\s+)?definition\s+of|what\s+does\s+.+?\s+mean)\b"
YES_NO_QUESTION_CI = r"^\s*(?:am|are|can|could|did|do|does|had|has|have|is|should|was|were|will|would)\b"
LIST_QUESTION_CI = r"\b(?:what are|which|list|features|functions|steps|requirements|advantages|disadvantages)\b"
COMPARISON_QUESTION_CI = r"\b(?:compare|comparison|difference|differences|versus|vs\.?|pros and cons)\b"
SHORT_VALUE_QUESTION_CI = r"^\s*(?:how many|how much|when|what (?:date|time|number|amount|price|size|color|colour|shape))\b"
NEGATIVE_CI = r"\b(?:cannot|can't|didn't|doesn't|hadn't|hasn't|haven't|isn't|never|no|not|unable|wasn't|weren't|without)\b"
UNSAFE_CI = r"(?:ignore\s+(?:all\s+)?(?:previous|prior)\s+instructions|follow\s+(?:these|the)\s+instructions|system\s+prompt|developer\s+prompt|reveal\s+the\s+system|^\s*(?:assistant|system|developer)\s*:)"
NUMBERED = r"^\s*\d+(?:\.\d+)*[.)]?\s+\S"
LIST_ITEM_CI = r"^\s*(?:[-*•–—]|o\s+)\s*\S"
BULLET_CI = "^(?:[-*•–—\uf0b7]|o\\s+)\\s*(.+)$"  # the private-use character is the bullet of office files
PAGE_LEADER = r"(?:\.{3,}|…{2,})\s*\d+\s*$"
SUBQUESTION_CUT_CI = r"\b(?:and|plus|also|with)\b|[,/;&]"

# Fixed value: what is said when the documents do not answer.
NO_ANSWER = "The provided documents do not contain enough information to answer this question."
