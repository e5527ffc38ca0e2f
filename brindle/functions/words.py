"""Characters that are replaced, words that searches leave out, the citation marker.

Results depend on these exact values; they are stated as such and not derived.
"""

# Characters without a canonical decomposition, and typographic marks.
LIGATURES = (("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Ø", "O"), ("ø", "o"), ("ß", "ss"))
TYPOGRAPHY = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("−", "-"))

# Words too common in rules text to weigh in a search.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "as", "if", "then", "that", "this", "these", "those", "is", "are", "be", "it", "its", "it's",
    "they", "them", "their", "there", "when", "while", "any", "all", "each", "no", "not", "only", "also", "may", "can", "will", "would", "could", "must", "has", "have",
    "had", "do", "does", "can't", "by", "at", "up", "out", "from", "onto", "into", "one", "two", "number", "put", "rule", "rules", "see", "player", "players", "card",
    "cards", "permanent", "permanents", "object", "objects", "creature", "creatures", "spell", "spells", "ability", "abilities", "effect", "effects", "game", "turn",
    "control", "controls", "controlled", "battlefield",
)

# Words that questions add and rules never hold.
QUESTION_WORDS = (
    "what", "why", "how", "when", "where", "which", "who", "whom", "whose", "does", "do", "did", "is", "are", "was", "were", "can", "could", "should", "would", "will",
    "happens", "happen", "work", "works", "mean", "means", "explain", "tell", "me", "my", "i", "you", "your", "please", "about", "still", "instead", "anything",
    "something", "someone", "everything", "it", "its", "they", "them", "their", "he", "she", "him", "her", "this", "that", "these", "those", "there",
)

CITATION_BODY = r"\[([a-z_]+:[^\]]+)\]"
