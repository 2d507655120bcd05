"""Operator 2: quality rules by distribution divergence, in DataFrame operations only.

A document's histogram of character classes, and for each language its histogram of common
words, are compared with references by Jensen-Shannon distance. A reference is the mean
histogram of a language's documents that pass the base rules, counted over the whole table.
A document is held against the nearest reference, so a wrong language label does no harm,
and short documents are not judged by histograms too sparse to tell.

Defined results: a null or empty text has no words and fails the base rules; rows that
share a ``doc_id`` are judged each; without references of any language the distances are
null and only the base rules decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import documents, whole_text, word_list
from skuflow.session import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Characters in words from which the histograms count, and the largest distances kept.
GUARD_CHARS = 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.325
#: Words from which the word histogram counts.
GUARD_WORDS = 150
SYMBOLS = "[#*$%&|<>]"

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in that is was for with this are be it on as at by from or".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
CLASSES = ["upper", "digit", "punct", "symbol", "gap", "other"]


def _word_column(language: str, word: str) -> str:
    return f"w_{language}_{word}"


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that the text has more than once."""

    def of_words(w: Column) -> Column:
        last = F.size(w) - 3
        at = F.sequence(F.lit(0), last)
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.sort_array(F.transform(at, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
            F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
            i.alias("i"),
        )))

        def covered(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce(
                    (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                    F.lit(False),
                )

            hit = F.filter(
                F.transform(s, lambda x, k: F.when(
                    same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]
                )),
                lambda p: p.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(
                F.transform(hit, lambda p: F.array(p, p + 1, p + 2))
            )))

        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        # A lambda's argument is computed once; a plain expression would be at each use.
        found = F.transform(F.array(windows), covered)[0]
        return F.when(F.size(w) < 3, 0).when(none, 0).otherwise(found)

    return F.transform(F.array(words), of_words)[0]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with the base counts and both histograms' counts."""
    text = F.col("_text")
    rows = docs.select(*[docs[c] for c in keep], whole_text(docs).alias("_text")).withColumn(
        "_words", word_list(text)
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    short = F.filter("_words", lambda w: F.octet_length(w) <= 5)
    counted = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "_chars": F.char_length(text),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.transform(
            F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))
        )[0].cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
        "upper": F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "digit": F.char_length(text) - F.char_length(F.regexp_replace(text, "[0-9]+", "")),
        "punct": F.char_length(text)
        - F.char_length(F.regexp_replace(text, r"[\p{Punct}&&[^#*$%&|<>]]+", "")),
        "_joined": F.concat(F.lit(" "), F.lower(F.array_join(short, "  ")), F.lit(" ")),
    })
    histograms = {
        "symbol": F.col("n_symbols"), "gap": F.col("_chars") - F.col("word_chars"),
        "other": F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("n_symbols"),
    }
    joined = F.col("_joined")
    distinct = sorted({w for words in COMMON_WORDS.values() for w in words})
    histograms |= {
        f"c_{w}": F.floor(
            (F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(f" {w} "), F.lit(""))))
            / (len(w.encode()) + 2)
        ).cast("int") for w in distinct
    }
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.withColumns(histograms).withColumn("base_failed", failed).drop(
        "_text", "_words", "_joined"
    )


def _class_parts() -> list[Column]:
    total = F.greatest(F.lit(1), F.col("_chars"))
    return [F.col(c) / total for c in CLASSES]


def _word_parts(language: str) -> list[Column]:
    """Shares of each common word, then of all other words."""
    total = F.greatest(F.lit(1), F.col("n_words"))
    hits = [F.col(f"c_{w}") for w in COMMON_WORDS[language]]
    return [*[h / total for h in hits], (F.col("n_words") - reduce(lambda a, b: a + b, hits)) / total]


def references(features: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each known language: a handful of rows, whatever the table."""
    good = features.where(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS))
    values = [F.avg(p).alias(f"k{i}") for i, p in enumerate(_class_parts())]
    for language in COMMON_WORDS:
        of_language = F.col("lang") == language
        values += [
            F.avg(F.when(of_language, p)).alias(f"{language}{i}")
            for i, p in enumerate(_word_parts(language))
        ]
    out = {}
    for row in good.groupBy("lang").agg(*values).collect():
        language = row["lang"]
        n = len(COMMON_WORDS[language]) + 1
        out[language] = (
            [row[f"k{i}"] for i in range(len(CLASSES))], [row[f"{language}{i}"] for i in range(n)]
        )
    return out


def js_distance(parts: list[Column], reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; 0 to 1."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        own = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        return own + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(F.array(*parts), F.array(*[F.lit(float(q)) for q in reference]), term)
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _nearest(distances: list[Column]) -> Column:
    if not distances:
        return F.lit(None).cast("double")
    return distances[0] if len(distances) == 1 else F.least(*distances)


def judged(features: DataFrame, known: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Features with the distances to the nearest references and the verdict."""
    classes = _nearest([js_distance(_class_parts(), c) for c, _ in known.values()])
    words = _nearest([js_distance(_word_parts(k), w) for k, (_, w) in known.items()])
    far = (F.col("word_chars") >= GUARD_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    far = far | (
        (F.col("n_words") >= GUARD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return features.withColumns({"class_distance": classes, "word_distance": words}).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    )


def passing(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with their columns.

    Rows are staged with their counts: the references read the counts alone, and the
    decision needs no join of counts and texts.
    """
    marked = docs.select(F.struct("*").alias("_doc"), docs["text"], docs["lang"])
    features = stage(measured(marked, ["_doc", "lang"]), "quality-features")
    return judged(features, references(features)).where("kept").select("_doc.*")


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stage(measured(documents(spark, sf_dir), ["doc_id", "lang"]), "quality-features")
    return judged(features, references(features)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
