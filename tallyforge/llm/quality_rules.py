"""Quality rules from distribution divergence, in DataFrame functions alone.

Base rules: too few words, or too many words in repeated 3-word windows. What passes them is
compared with references of all of the corpus's languages by the Jensen-Shannon distance (base 2, between
0 and 1) of two histograms: character classes, and common words with one further class for all
other words. A reference is the histogram over all documents of one language. Up to ``INLINE``
references are part of the expressions; further ones are a broadcast table of one row. A document is kept if some language is near in both histograms.
Texts shorter than ``MIN_CHARS`` characters in words or ``MIN_WORDS`` words are not judged by
distance, as their histograms are noise; the base rules alone decide.

All work is row-wise expressions and two aggregations over a few counts per language; no text is
shuffled. A window of words is told by a 64-bit hash within its own document.

Defined cases: a null text has no words and fails the base rules; without any reference (no
document has a language) nothing is judged by distance. Rows that repeat give equal rows; other
columns pass through ``keep_by_rules`` and are ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE_CHARS, SPACE_CLASS, stored, table

MIN_BASE_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_WORDS = 50
MIN_CHARS = 200
#: References written into the plan itself, which would grow with more.
INLINE = 32
#: A distance may exceed these by an allowance that falls with the square root of the number of words.
MOST_CLASS_DISTANCE = 0.24
MOST_WORD_DISTANCE = 0.25
CLASS_ALLOWANCE = 0.5
WORD_ALLOWANCE = 1.0

#: Common words of four languages; what is compared is their shares in the corpus itself.
COMMON = sorted(
    set(
        "the of and to in a is that for it on with as are be by this was at from or an "
        "der die das und in zu den mit von ist auf für im nicht ein eine dem sich des auch "
        "de la le et les des en un une du est que qui dans pour sur au par avec pas "
        "de la que el en y los del se las por un para con no una su al es como".split()
    )
)
SYMBOLS = "[#*$%&|<>]"
#: Character classes in the order in which a text is stripped of them; what is left is the last class.
CLASSES = [r"[a-z]+", r"[A-Z]+", r"[.,;:?'\"()\-]+", r"[0-9]+", r"[\p{L}&&[^\p{Lu}]]+", r"\p{Lu}+"]

#: Number of the remainder in which symbols are counted; the classes before it hold none of them.
N_BEFORE_SYMBOLS = 3


def word_array(text: Column) -> Column:
    """Words of a text; none for null."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


def _stripped(df: DataFrame, joined: str) -> tuple[DataFrame, Column]:
    """Adds what is left of the joined words after each class, and the counts of all classes."""
    names = [joined]
    for k, pattern in enumerate(CLASSES):
        names.append(f"__left{k}")
        df = df.withColumn(names[-1], F.regexp_replace(names[-2], pattern, ""))
    sizes = [F.length(n) for n in names]
    return df, F.array(*[a - b for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1]).cast("array<double>")


def _lines_repeated(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    return F.transform(F.array(filled), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]


def _repeat_words(df: DataFrame, words: str) -> DataFrame:
    """Adds ``__covered``, the number of words in 3-word windows that occur twice or more."""
    w = F.col(words)
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("__windows", F.when(F.size(w) < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), window))))
    s = F.col("__windows")
    # windows are sorted by hash, so equal ones are neighbours
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))), lambda j: F.get(s, j)["h"] == F.get(s, j + 1)["h"])
    df = df.withColumn("__pairs", pairs)
    both = F.array_distinct(F.concat("__pairs", F.transform("__pairs", lambda j: j + 1)))
    df = df.withColumn("__places", F.sort_array(F.transform(both, lambda j: F.get(s, j)["i"])))
    p = F.col("__places")
    steps = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))))
    return df.withColumn("__covered", F.aggregate(steps, F.lit(0), lambda a, x: a + x))


def _common_counts(df: DataFrame, words: str) -> DataFrame:
    """Adds ``__found``, the common words of a document with their counts: (word's number, count)."""
    df = df.withColumn("__common", F.sort_array(F.transform(F.filter(words, lambda w: F.lower(w).isin(COMMON)), lambda w: F.lower(w))))
    df = df.withColumn("__kinds", F.array_distinct("__common"))
    df = df.withColumn("__firsts", F.transform("__kinds", lambda w: F.array_position("__common", w)))
    numbers = F.array(*[F.lit(w) for w in COMMON])
    after = lambda j: F.coalesce(F.get("__firsts", j + 1), F.size("__common") + 1)
    return df.withColumn("__found", F.transform("__kinds", lambda w, j: F.struct(F.array_position(numbers, w).cast("int").alias("k"), (after(j) - F.get("__firsts", j)).cast("long").alias("n"))))


def references(docs: DataFrame) -> list[tuple[str, list[float], list[float]]]:
    """Language, shares of character classes and shares of common words with all others last; over all documents."""
    df = docs.select("lang", F.when(F.col("lang").isNotNull(), word_array(F.col("text"))).alias("__words"))
    df, classes = _stripped(df.withColumn("__joined", F.array_join("__words", "")), "__joined")
    df = _common_counts(df, "__words")
    whole = F.transform(classes, lambda c, j: F.struct((-j - 2).cast("int").alias("k"), c.cast("long").alias("n")))
    entries = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.size("__words").cast("long").alias("n"))), whole, "__found")
    sums = stored(df.select("lang", F.explode(entries).alias("e")).groupBy("lang", "e.k").agg(F.sum("e.n").alias("n")), "language-sums")
    total = sums.where("lang is not null and k = -1 and n > 0").select("lang")
    found: dict[str, dict[int, int]] = {}
    for row in sums.join(total, "lang").collect():  # words and classes of each language
        found.setdefault(row["lang"], {})[row["k"]] = row["n"]
    out = []
    for name, counts in sorted(found.items()):
        chars = [float(counts.get(-j - 2, 0)) for j in range(len(CLASSES) + 1)]
        words = [float(counts.get(k, 0)) for k in range(1, len(COMMON) + 1)]
        words.append(counts[-1] - sum(words))
        out.append((name, [c / max(sum(chars), 1) for c in chars], [w / counts[-1] for w in words]))
    return out


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _distance(shares: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two histograms."""
    terms = F.zip_with(shares, other, _divergence)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _divergence(p: Column, q: Column) -> Column:
    """One class's part of the Jensen-Shannon divergence."""
    return (_xlogx(p) + _xlogx(q)) / 2 - _xlogx((p + q) / 2)


def _word_distance(n_words: Column, shares: Column, last: Column, half: Column) -> Column:
    """The same for common words, from those that occur: a class that one side lacks adds half of the other's share.

    ``last`` is the reference's share of all other words, ``half`` half of the sum of the rest.
    """

    def part(x: Column) -> Column:
        q = F.get(shares, x["k"] - 1)
        return _divergence(x["n"] / n_words, q) - q / 2

    rest = _divergence((n_words - F.size("__common")) / n_words, last)
    total = F.aggregate(F.transform("__found", part), F.lit(0.0), lambda a, x: a + x) + half + rest
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def measured(docs: DataFrame, refs: list[tuple[str, list[float], list[float]]]) -> DataFrame:
    """``docs`` with the base counts and, for the nearest language, ``class_distance`` and ``word_distance``."""
    df = docs.withColumn("__words", word_array(F.col("text")))
    df = df.withColumn("n_words", F.size("__words").cast("long")).withColumn("__joined", F.array_join("__words", ""))
    df, classes = _stripped(df, "__joined")
    df = df.withColumn("__classes", F.transform(classes, lambda c: c / F.greatest(F.length("__joined"), F.lit(1))))
    df = _common_counts(_repeat_words(df, "__words"), "__words")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    if refs:
        most_class, most_words = limits(F.col("n_words"))
        numbers = lambda x: F.array(*[F.lit(q) for q in x])
        measure = lambda c, w, last, half, name: F.struct(_distance(F.col("__classes"), c).alias("c"), _word_distance(n, w, last, half).alias("w"), name.alias("lang"))
        df = df.withColumn("__each", F.array(*[measure(numbers(c), numbers(w), F.lit(w[-1]), F.lit(sum(w[:-1]) / 2), F.lit(name)) for name, c, w in refs[:INLINE]]))
        if len(refs) > INLINE:
            rest = [(name, c, w, w[-1], sum(w[:-1]) / 2) for name, c, w in refs[INLINE:]]
            held = docs.sparkSession.createDataFrame([(rest,)], "__refs array<struct<lang:string,c:array<double>,w:array<double>,last:double,half:double>>")
            df = df.crossJoin(F.broadcast(held))
            df = df.withColumn("__each", F.concat("__each", F.transform("__refs", lambda r: measure(r["c"], r["w"], r["last"], r["half"], r["lang"]))))
        ranked = F.transform("__each", lambda x: F.struct(F.greatest(x["c"] / most_class, x["w"] / most_words).alias("worst"), x["lang"].alias("lang"), x["c"].alias("c"), x["w"].alias("w")))
        df = df.withColumn("__nearest", F.array_min(ranked))
    else:
        df = df.withColumn("__nearest", F.lit(None).cast("struct<worst:double,lang:string,c:double,w:double>"))
    return df.select(
        *docs.columns,
        "n_words",
        F.length("__joined").cast("long").alias("word_chars"),
        F.regexp_count(f"__left{N_BEFORE_SYMBOLS}", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.coalesce(_lines_repeated(F.col("text")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("__covered").cast("long").alias("n_repeat_words"),
        F.col("__nearest.c").alias("class_distance"),
        F.col("__nearest.w").alias("word_distance"),
    )


def limits(n_words: Column) -> tuple[Column, Column]:
    """The largest distances of a document of so many words; short histograms are further from any reference by chance."""
    root = F.sqrt(F.greatest(n_words, F.lit(1)))
    return MOST_CLASS_DISTANCE + CLASS_ALLOWANCE / root, MOST_WORD_DISTANCE + WORD_ALLOWANCE / root


def judged(found: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    short = (F.col("n_words") < MIN_WORDS) | (F.col("word_chars") < MIN_CHARS) | F.col("class_distance").isNull()
    most_class, most_words = limits(F.col("n_words"))
    near = (F.col("class_distance") <= most_class) & (F.col("word_distance") <= most_words)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (short | near))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and both distances of every document."""
    items = docs.select("doc_id", "text")
    return judged(measured(items, references(docs))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    found = judged(measured(packed, references(docs)))
    # exploding no row where a document is rejected, as a filter's condition would be moved below, and its inputs computed anew for each use
    return found.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(table(spark, sf_dir, "documents"))
