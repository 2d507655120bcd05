"""Operator 9: licences by canonical digest.

A text is made canonical (lower case, copyright statements gone, punctuation and white space to
single spaces, equivalent spellings to one, a licence's title in front gone), digested, and the
digest is joined with those of known licence texts. So line breaks, comment signs and titles do
not count. A copyright statement is a line that begins, other signs apart, with ``copyright`` and a
sign, a year or a place for one, with the sign itself, or that says ``all rights reserved`` and no more; wording
that happens to begin a line with ``copyright`` stays. Each line is looked up among known notices
in the same way, except that titles stay.

Output for each row: ``doc_id``, ``canonical_sha256``, ``license`` (of the whole text, else
null), ``notices`` (sorted distinct licences that lines name), ``n_notices`` (such lines).

Defined results: a null text is empty; a canonical form without words matches nothing; of known
names whose texts are equal in canonical form the least counts; rows that share a ``doc_id`` are
scanned each; very long texts are scanned whole; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import documents, texts
from skuflow.llm.license_texts import NOTICES, SPELLINGS, TEXTS, TITLES

_YEAR = r"[\[<{]?(?:(?:19|20)\d\d|year|yyyy)"
_GAP = r"[^\S\n]*"
_STATEMENT = (
    r"(?md)^[^\p{L}\p{N}\n(©]*(?:"
    rf"copyright{_GAP}(?:\(c\)|©|{_YEAR}).*|\(c\){_GAP}(?:copyright|{_YEAR}).*|©.*"
    r"|all rights reserved[^\p{L}\p{N}\n]*)$"
)
_NO_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Canonical words of a text, with a space before and behind each and its line breaks."""
    out = F.regexp_replace(F.lower(text), _STATEMENT, " ")
    out = F.regexp_replace(out, _NO_WORD, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for spelling, other in SPELLINGS.items():
        # Twice, since neighbours share the space between them.
        for _ in range(2):
            out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {other} "))
    return out


def canonical(lines: Column) -> Column:
    """Canonical form of a text from its canonical lines."""
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def untitled(form: Column) -> Column:
    """A canonical form without a licence's title in front."""
    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    return F.regexp_replace(form, f"^(?:{titles}) ", "")


def digest(form: Column) -> Column:
    """Digest of a canonical form; null when it has no words."""
    return F.when(form != "", F.sha2(form, 256))


def _known(spark: SparkSession, by_text: list[tuple[str, str]], form) -> DataFrame:
    """Digest, length and licence of a caller's fixed list of texts; the least name of equal ones."""
    known = spark.createDataFrame(by_text, "license string, text string")
    formed = known.select("license", form(canonical(canonical_lines(F.col("text")))).alias("form"))
    return formed.where("form <> ''").groupBy(digest(F.col("form")).alias("known_sha256")).agg(
        F.min("license").alias("license"), F.max(F.length("form")).alias("length")
    )


def scan(docs: DataFrame, licenses: dict[str, str] | None = None,
         notices: dict[str, str] | None = None) -> DataFrame:
    """Licence of each whole text and the notices among its lines."""
    spark = docs.sparkSession
    licenses = TEXTS if licenses is None else licenses
    notices = NOTICES if notices is None else notices
    known = _known(spark, list(licenses.items()), untitled)
    # The list of notices is the caller's, so its digests are a literal table.
    listed = _known(spark, [(name, text) for text, name in notices.items()], lambda form: form).collect()
    rows = texts(docs).select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    found = F.array().cast("array<string>")
    if listed:
        table = F.create_map(*[F.lit(x) for r in listed for x in (r["known_sha256"], r["license"])])
        # Only a form as long as a notice's can be one: the others need no digest.
        lengths = sorted({r["length"] for r in listed})
        forms = F.transform(F.split("_lines", "\n"), canonical)
        asked = F.filter(forms, lambda form: F.length(form).isin(lengths))
        named = F.transform(asked, lambda form: F.element_at(table, digest(form)))
        found = F.filter(named, lambda name: name.isNotNull())
    rows = rows.select(
        "doc_id", digest(untitled(canonical(F.col("_lines")))).alias("canonical_sha256"), found.alias("_found")
    )
    known = known.select("known_sha256", "license")
    return rows.join(F.broadcast(known), F.col("canonical_sha256") == F.col("known_sha256"), "left").select(
        "doc_id", "canonical_sha256", "license",
        F.array_join(F.sort_array(F.array_distinct("_found")), ",").alias("notices"),
        F.size("_found").cast("long").alias("n_notices"),
    )


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
