"""Fixed values of the data model, and the small dimension tables made of them.

Longer tables (verse counts of all chapters, hymns, known talks) are parameters, read from tables at rest: see
verse_counts() and hymn_names().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Node types in their persisted order, 0 to 33.
NODE_TYPES = (
    "Unknown", "Entity", "Word", "NGram", "ScriptureVerse", "TopicalGuideKeyword", "ScriptureChapter", "ScriptureBook",
    "BibleDictionaryTopic", "BibleDictionaryParagraph", "GuideToScripturesTopic", "TripleIndexTopic", "ConferenceTalk",
    "ConferenceTalkParagraph", "ConferenceSpeaker", "CharNGram", "ScriptureSupplementalPara", "BookChapter", "BookParagraph",
    "Conference", "Year", "ByuSpeech", "ByuSpeechParagraph", "Hymn", "HymnVerse", "Proclamation", "ProclamationParagraph",
    "ScriptureSentence", "BibleDictionarySentence", "ConferenceTalkSentence", "ScriptureSupplementalParaSentence",
    "BookSentence", "ByuSpeechSentence", "ProclamationSentence",
)
TYPE = {name: k for k, name in enumerate(NODE_TYPES)}

# Weights of feature types, in tenths; types not named weigh 10.
WEIGHT10 = {"WordAssociation": 1, "NgramAssociation": 7, "WordDesignation": 30, "ScriptureReference": 10, "ScriptureReferenceWithoutEmphasis": 8}
DEFAULT_WEIGHT10 = 10

# Which sentence type belongs to which paragraph type.
SENTENCE_OF = {
    "ScriptureVerse": "ScriptureSentence", "BibleDictionaryParagraph": "BibleDictionarySentence", "ConferenceTalkParagraph": "ConferenceTalkSentence",
    "ScriptureSupplementalPara": "ScriptureSupplementalParaSentence", "BookParagraph": "BookSentence", "ByuSpeechParagraph": "ByuSpeechSentence",
    "ProclamationParagraph": "ProclamationSentence",
}

# Books in reading order: id, canon, English name, chapters.
BOOKS = (
    ("gen", "ot", "Genesis", 50), ("ex", "ot", "Exodus", 40), ("lev", "ot", "Leviticus", 27), ("num", "ot", "Numbers", 36),
    ("deut", "ot", "Deuteronomy", 34), ("josh", "ot", "Joshua", 24), ("judg", "ot", "Judges", 21), ("ruth", "ot", "Ruth", 4),
    ("1-sam", "ot", "1 Samuel", 31), ("2-sam", "ot", "2 Samuel", 24), ("1-kgs", "ot", "1 Kings", 22), ("2-kgs", "ot", "2 Kings", 25),
    ("1-chr", "ot", "1 Chronicles", 29), ("2-chr", "ot", "2 Chronicles", 36), ("ezra", "ot", "Ezra", 10), ("neh", "ot", "Nehemiah", 13),
    ("esth", "ot", "Esther", 10), ("job", "ot", "Job", 42), ("ps", "ot", "Psalms", 150), ("prov", "ot", "Proverbs", 31),
    ("eccl", "ot", "Ecclesiastes", 12), ("song", "ot", "Song of Solomon", 8), ("isa", "ot", "Isaiah", 66), ("jer", "ot", "Jeremiah", 52),
    ("lam", "ot", "Lamentations", 5), ("ezek", "ot", "Ezekiel", 48), ("dan", "ot", "Daniel", 12), ("hosea", "ot", "Hosea", 14),
    ("joel", "ot", "Joel", 3), ("amos", "ot", "Amos", 9), ("obad", "ot", "Obadiah", 1), ("jonah", "ot", "Jonah", 4),
    ("micah", "ot", "Micah", 7), ("nahum", "ot", "Nahum", 3), ("hab", "ot", "Habakkuk", 3), ("zeph", "ot", "Zephaniah", 3),
    ("hag", "ot", "Haggai", 2), ("zech", "ot", "Zechariah", 14), ("mal", "ot", "Malachi", 4),
    ("matt", "nt", "Matthew", 28), ("mark", "nt", "Mark", 16), ("luke", "nt", "Luke", 24), ("john", "nt", "John", 21),
    ("acts", "nt", "Acts", 28), ("rom", "nt", "Romans", 16), ("1-cor", "nt", "1 Corinthians", 16), ("2-cor", "nt", "2 Corinthians", 13),
    ("gal", "nt", "Galatians", 6), ("eph", "nt", "Ephesians", 6), ("philip", "nt", "Philippians", 4), ("col", "nt", "Colossians", 4),
    ("1-thes", "nt", "1 Thessalonians", 5), ("2-thes", "nt", "2 Thessalonians", 3), ("1-tim", "nt", "1 Timothy", 6), ("2-tim", "nt", "2 Timothy", 4),
    ("titus", "nt", "Titus", 3), ("philem", "nt", "Philemon", 1), ("heb", "nt", "Hebrews", 13), ("james", "nt", "James", 5),
    ("1-pet", "nt", "1 Peter", 5), ("2-pet", "nt", "2 Peter", 3), ("1-jn", "nt", "1 John", 5), ("2-jn", "nt", "2 John", 1),
    ("3-jn", "nt", "3 John", 1), ("jude", "nt", "Jude", 1), ("rev", "nt", "Revelation", 22),
    ("1-ne", "bofm", "1 Nephi", 22), ("2-ne", "bofm", "2 Nephi", 33), ("jacob", "bofm", "Jacob", 7), ("enos", "bofm", "Enos", 1),
    ("jarom", "bofm", "Jarom", 1), ("omni", "bofm", "Omni", 1), ("w-of-m", "bofm", "Words of Mormon", 1), ("mosiah", "bofm", "Mosiah", 29),
    ("alma", "bofm", "Alma", 63), ("hel", "bofm", "Helaman", 16), ("3-ne", "bofm", "3 Nephi", 30), ("4-ne", "bofm", "4 Nephi", 1),
    ("morm", "bofm", "Mormon", 9), ("ether", "bofm", "Ether", 15), ("moro", "bofm", "Moroni", 10),
    ("dc", "dc-testament", "Doctrine & Covenants", 138), ("od", "dc-testament", "Official Declarations", 2),
    ("moses", "pgp", "Moses", 8), ("abr", "pgp", "Abraham", 5), ("js-m", "pgp", "Joseph Smith - Matthew", 1),
    ("js-h", "pgp", "Joseph Smith - History", 1), ("a-of-f", "pgp", "Articles of Faith", 1),
)

# Canons with their names, and the reference works among them.
CANONS = {
    "ot": "Old Testament", "nt": "New Testament", "bofm": "Book of Mormon", "dc-testament": "Doctrine and Covenants", "pgp": "Pearl of Great Price",
    "tg": "Topical Guide", "bd": "Bible Dictionary", "gs": "Guide to the Scriptures", "triple-index": "Index to the Triple Combination",
}
REFERENCE_WORKS = {"tg": "TopicalGuideKeyword", "bd": "BibleDictionaryTopic", "gs": "GuideToScripturesTopic", "triple-index": "TripleIndexTopic"}

# Book ids of other spellings, with their canon where it changes.
BOOK_IDS = {
    "jst-matt": ("js-m", None), "jst-luke": ("luke", "nt"), "jst-mark": ("mark", "nt"), "jst-heb": ("heb", "nt"),
    "moroni": ("moro", None), "numb": ("num", None), "abraham": ("abr", None),
}

#: No chapter has more verses; it bounds those whose length isn't known.
MOST_VERSES = 176


def verse_counts(table: DataFrame) -> dict[str, tuple[int, ...]]:
    """Verses of the chapters of each book, for what takes `verses`, from a table (book, chapter, verses) of one row a chapter."""
    out: dict[str, dict[int, int]] = {}
    for r in table.select("book", "chapter", "verses").collect():
        out.setdefault(r["book"], {})[r["chapter"]] = r["verses"]
    return {book: tuple(n.get(c, MOST_VERSES) for c in range(1, max(n) + 1)) for book, n in out.items()}


def hymn_names(table: DataFrame) -> dict[int, str]:
    """Songs by their numbers, from a table (number, song)."""
    return {r["number"]: r["song"] for r in table.select("number", "song").collect()}


def node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NODE_TYPES)), "type short, type_name string")


def feature_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHT10.items()), "feature string, weight10 long")


def books(spark: SparkSession) -> DataFrame:
    rows = [(k, *b) for k, b in enumerate(BOOKS)]
    return spark.createDataFrame(rows, "book_order int, book string, canon string, name string, chapters int")


def chapters(spark: SparkSession, verses: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """(book_order, book, canon, chapter, verses): one row a chapter; verses is null where unknown."""
    known = verses or {}
    rows = [(k, b, canon, c, known[b][c - 1] if c <= len(known.get(b, ())) else None) for k, (b, canon, _, n) in enumerate(BOOKS) for c in range(1, n + 1)]
    return spark.createDataFrame(rows, "book_order int, book string, canon string, chapter int, verses int")
