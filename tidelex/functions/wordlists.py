"""Word lists used by cleaning, language detection and the default scorer."""

# The stop words of the token filter.
STOP_WORDS = """
a an the and or but if because as what when where how is are was were be been being
have has had do does did to at by for with about against between into through during
before after above below from up down in out on off over under again further then once
here there all any both each few more most other some such no nor not only own same so
than too very
""".split()

# Frequent function words per language; the order of languages breaks ties.
LANGUAGE_WORDS = {
    "en": "the of and to in a is that for it on was with be as by this are at from".split(),
    "de": "der die und den von zu das sich mit auf für ist nicht ein dem eine als im auch es".split(),
    "fr": "de la le et les des un une du en que est pour qui dans par pas sur au avec".split(),
    "es": "de la que el en y los del las un por con una su para es al lo como se".split(),
}

# Words of the default scorer and their weights.
LEXICON = {
    "love": 3.0, "excellent": 3.0, "amazing": 3.0, "outstanding": 3.0, "brilliant": 3.0,
    "great": 2.0, "good": 2.0, "happy": 2.0, "win": 2.0, "gain": 2.0, "profit": 2.0,
    "best": 2.0, "strong": 2.0, "growth": 2.0, "success": 2.0, "bullish": 2.0,
    "like": 1.0, "nice": 1.0, "better": 1.0, "up": 1.0, "positive": 1.0, "rest": 1.0,
    "hope": 1.0, "safe": 1.0, "fair": 1.0, "calm": 1.0,
    "hate": -3.0, "worthless": -3.0, "disgusting": -3.0, "pathetic": -3.0, "terrible": -3.0,
    "awful": -3.0, "fraud": -3.0,
    "bad": -2.0, "stupid": -2.0, "idiot": -2.0, "moron": -2.0, "loser": -2.0, "trash": -2.0,
    "crash": -2.0, "loss": -2.0, "bearish": -2.0, "scam": -2.0, "fail": -2.0,
    "clown": -1.0, "weak": -1.0, "worse": -1.0, "risk": -1.0, "negative": -1.0, "fear": -1.0,
    "debt": -1.0, "drop": -1.0,
}

#: Base forms of irregular English words.
LEMMA_EXCEPTIONS = {
    "was": "be", "were": "be", "is": "be", "are": "be", "am": "be", "been": "be", "has": "have", "had": "have", "having": "have",
    "does": "do", "did": "do", "done": "do", "went": "go", "gone": "go", "goes": "go", "said": "say", "made": "make", "making": "make",
    "bought": "buy", "sold": "sell", "lost": "lose", "losing": "lose", "rose": "rise", "risen": "rise", "fell": "fall", "fallen": "fall",
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "mice": "mouse",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "this": "this", "news": "news", "thing": "thing", "nothing": "nothing",
    "something": "something", "during": "during", "his": "his", "its": "its", "us": "us", "need": "need", "red": "red",
}
#: Suffix, letters cut from the end, letters added; the first that fits counts.
LEMMA_RULES = [
    *[(2 * c + "ing", 4, "") for c in "bdgmnprt"], *[(2 * c + "ed", 3, "") for c in "bdgmnprt"],
    ("ying", 3, ""), ("ating", 3, "e"), ("izing", 3, "e"), ("ing", 3, ""), ("ated", 1, ""), ("ized", 1, ""), ("ied", 3, "y"), ("eed", 0, ""), ("ed", 2, ""),
    ("sses", 2, ""), ("ches", 2, ""), ("shes", 2, ""), ("xes", 2, ""), ("ies", 3, "y"), ("ss", 0, ""), ("us", 0, ""), ("is", 0, ""), ("s", 1, ""),
]
