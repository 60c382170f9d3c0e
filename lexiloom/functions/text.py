"""Text functions (Column -> Column): four tokenisers that differ on purpose, shingles, n-grams, stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words without apostrophes (those with one can never equal a token).
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
# Words that the spiral word cloud drops as well.
SPIRAL_EXTRA = "product item one will bought amazon review use return really get".split()
# The word-cloud stop words without apostrophes, and what the two cloud grids add to them.
CLOUD_STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between "
    "both but by can cannot com could did do does doing down during each else ever few for from further get had has "
    "have having he hence her here hers herself him himself his how however http i if in into is it its itself just "
    "k like me more most my myself no nor not of off on once only or other otherwise ought our ours ourselves out "
    "over own r same shall she should since so some such than that the their theirs them themselves then there "
    "therefore these they this those through to too under until up very was we were what when where which while who "
    "whom why with would www you your yours yourself yourselves"
).split()
CONTRAST_EXTRA = "product item one will bought amazon".split()
GRID_EXTRA = "product item one will bought amazon return".split()

#: Letters, numbers and underscore of any script; \w alone is ASCII in Java.
WORD = r"[\p{L}\p{N}_]+"
#: A whole run of WORD that is two letters or more.
LETTERS = r"(?<![\p{L}\p{N}_])\p{L}{2,}+(?![\p{L}\p{N}_])"
#: The white space that str.split() knows, as the inside of a character class.
SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case word tokens without stop words (first tokeniser). Null text gives null."""
    tokens = _all(F.lower(text), WORD)
    return F.filter(tokens, lambda w: ~w.isin(*stopwords)) if stopwords else tokens


def alpha_words(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """words() of two letters or more and nothing but letters (second tokeniser). One pattern finds them: to test each
    word of words() by itself takes about 1.4 times as long."""
    tokens = _all(F.lower(text), LETTERS)
    return F.filter(tokens, lambda w: ~w.isin(*stopwords)) if stopwords else tokens


def clean(text: Column) -> Column:
    """Lower case; whatever is neither word character nor white space is deleted, not replaced."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{SPACE}]", "")


def cloud_words(text: Column, stopwords: list[str], least: int = 3) -> Column:
    """clean() split at white space, without stop words and words under `least` characters (third tokeniser).

    clean() leaves word characters and white space only, so the words are runs of WORD: Java tests each letter against
    every range of SPACE before it is found in none."""
    return F.filter(_all(clean(text), WORD), lambda w: ~w.isin(*stopwords) & (F.length(w) >= least))


def spaced(text: Column) -> Column:
    """Runs of anything but white space, as they stand (fourth tokeniser)."""
    return _all(text, f"[^{SPACE}]+")


def first_place() -> Column:
    """The smallest (review_id, place) of a group as one number, review_id * 2^32 + place. Groups with a least struct
    are made by sorting all rows; a number of fixed width is kept in the hash table."""
    return F.min(F.col("review_id").cast("decimal(20,0)") * F.lit(2**32) + F.col("place"))


def unplaced(first: Column) -> Column:
    """(review_id, place) of first_place()."""
    place = F.pmod(first, F.lit(2**32))
    return F.struct(((first - place) / F.lit(2**32)).cast("bigint").alias("review_id"), place.cast("int").alias("place"))


def preprocess(text: Column) -> Column:
    return F.array_join(alpha_words(text), " ")


def joined(text: Column) -> Column:
    """The string that character shingles are taken from: words() with underscores between them."""
    return F.array_join(words(text), "_")


def shingles(text: Column, q: int = 3) -> Column:
    """Distinct q-character shingles of joined(text), in order of first appearance. One regex pass: substring
    at each place would take a time quadratic in the length of the text. A shingle may not start inside a
    surrogate pair."""
    pattern = rf"(?s)(?=(.{{{q}}}))(?![\x{{DC00}}-\x{{DFFF}}])"
    return F.array_distinct(F.regexp_extract_all(joined(text), F.lit(pattern), F.lit(1)))


def ngrams(tokens: Column, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams of lo to hi tokens, each joined by one blank, with repetitions. Each size is the size below and the
    tokens further on, side by side: a slice for every n-gram would copy the tokens each time."""

    def of(t: Column, n: int) -> Column:
        if n == 1:
            return t
        many = F.size(t) - (n - 1)
        grams = F.zip_with(F.slice(of(t, n - 1), 1, many), F.slice(t, n, many), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(many > 0, grams).otherwise(F.array().cast("array<string>"))

    # the outer transform() names the tokens: within a lambda their expression would be evaluated for each n-gram
    return F.transform(F.array(tokens), lambda t: F.concat(*[of(t, n) for n in range(lo, hi + 1)]))[0]
