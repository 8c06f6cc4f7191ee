"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern. The hashes of all of them are counted over the whole corpus by
distinct repository and distinct owner: a value in many repositories or of many owners is a widely
copied example, one that few hold and that looks like a credential is reported as ``live``.

``owner`` and ``repository`` are column names. ``documents`` has neither; there, a ``source`` stands in
for the owner, and its documents of one ``lang`` for one of the owner's repositories. A hash may stand in a third of all documents, so the counts go
through three partial aggregations, and the verdicts return to the documents over salted keys:
each hash has at most :data:`SALTS` copies of its verdict. No Python runs on the executors.

Null text is empty; a null owner or repository counts as one owner of its own; null ids and repeated
rows each get their row, and repeated rows do not add owners; of the spans of one text those at one
place are ordered by kind; a text of any length is scanned whole, in time that grows with it; extra
columns, also such as ``live`` or ``counts``, do not reach the query; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, from_blocks, in_blocks, match_spans, span_list, span_text, whole_text

BASE_KINDS = ["assign", "access", "hex"]
SALTS = 256
MAX_OWNERS = 2
#: More than :data:`MAX_OWNERS`, as an owner has a repository at least.
MAX_REPOS = 3
MIN_DISTINCT = 8

PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|foobar|123456)"


def _secret(kind: str, value: Column) -> Column:
    return F.regexp_replace(value, _VALUE, "") if kind == "assign" else value


def live_looking(kind: str, found: Column) -> Column:
    """Random enough for a credential: many distinct characters and no placeholder word; digits
    among letters, but for access keys and passwords, which their kind tells."""
    value = _secret(kind, found)
    likely = (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT) & ~F.regexp_like(value, F.lit(_PLACEHOLDER))
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    if kind == "access":
        return likely
    return likely & (mixed | F.regexp_like(found, F.lit("(?i)^passw"))) if kind == "assign" else likely & mixed


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``m_<kind>`` arrays and ``cands``: ``array<struct<start, end, hash, live>>``
    with the secret's own span (the value without the key before it), once per kind that finds it."""
    df = docs.withColumn("__text", whole_text(text))
    df = match_spans(df, "__text", PATTERNS).drop("__text")
    df = df.withColumn("m_assign", F.filter("m_assign", lambda s: F.length(_secret("assign", s["value"])) >= 8))

    def candidates(kind):
        def one(s):
            v = _secret(kind, s["value"])
            return F.struct((s["end"] - F.length(v)).alias("start"), s["end"].alias("end"), F.sha2(v, 256).alias("hash"), live_looking(kind, s["value"]).alias("live"))

        return F.transform(F.col(f"m_{kind}"), one)

    return df.withColumn("cands", F.concat(*[candidates(k) for k in BASE_KINDS]))


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, owner, repository, live) rows to ``hash, n_repos, n_owners, live``, exact for hot
    hashes too. A value that looks like a credential in one place is one everywhere."""
    repos = cands.groupBy("hash", "owner", "repository").agg(F.max("live").alias("live"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.max("live").alias("live"))
    return owners.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("live").alias("live"))


def scan(docs: DataFrame, owner: str = "source", repository: list[str] | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Rows of ``docs`` (its columns kept) plus ``m_<kind>``, ``cands``, ``live_at`` and
    ``live`` (the sorted spans and hashes judged live), ``common`` (the widely copied ones, whatever they look like) and
    ``counts`` (``hash, n_owners, n_repos`` of every candidate)."""
    repository = repository or [owner, "lang"]
    keys = {c: F.col(f"`{c}`") for c in docs.columns}
    name = lambda cols: F.concat_ws("\x1f", *[F.coalesce(keys[c].cast("string"), F.lit("\x00")) for c in cols])
    marked = docs.withColumns({"__owner": name([owner]), "__repo": name(repository), "__row": F.md5(F.concat_ws("\x1f", F.coalesce(keys["doc_id"].cast("string"), F.lit("\x00")), whole_text()))})
    found = cut(find_candidates(marked).drop("text"))
    each = found.select("__row", "__owner", "__repo", F.explode("cands").alias("c")).select("__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repository"), "c.*")
    verdict = ownership(each).withColumnRenamed("live", "looks").withColumn("rare", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    salted = each.select("__row", "hash", "start", "end", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).alias("salt"))
    copies = salted.select("hash", "salt").distinct().join(verdict, "hash")
    kept = F.col("rare") & F.col("looks")
    # spans of the text are judged one by one, so that a text with very many takes no longer for each
    judged = salted.join(copies, ["hash", "salt"]).groupBy("__row").agg(
        F.array_sort(F.collect_set(F.when(kept, F.struct("start", "end")))).alias("live_at"),
        F.array_sort(F.collect_set(F.when(kept, F.col("hash")))).alias("live"),
        F.array_sort(F.collect_set(F.when(~F.col("rare"), F.col("hash")))).alias("common"),
        F.array_sort(F.collect_set(F.struct("hash", "n_owners", "n_repos"))).alias("counts"),
    )
    empty = {c: F.array().cast(judged.schema[c].dataType) for c in ("live_at", "live", "common", "counts")}
    return found.join(judged, "__row", "left").withColumns({c: F.coalesce(F.col(c), none) for c, none in empty.items()})


def live_spans() -> Column:
    """Spans of the live credentials, as :func:`span_list` gives the base ones."""
    return F.transform("live_at", lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE_KINDS)).alias("kind_order"), c["end"].alias("end"), F.lit("live").alias("kind")))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the base spans' digest, all spans, how many spans are live and
    how many values common, and the most owners and repositories that one of its values has."""
    df = scan(docs.select("doc_id", "text", "lang", "source"))
    base = span_list(BASE_KINDS)
    added = live_spans()
    return df.select(
        "doc_id",
        *[F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat(base, added))).alias("spans"),
        F.size(added).cast("long").alias("n_live"),
        F.size("common").cast("long").alias("n_common"),
        F.coalesce(F.array_max(F.transform("counts", lambda c: c["n_owners"])), F.lit(0)).alias("max_owners"),
        F.coalesce(F.array_max(F.transform("counts", lambda c: c["n_repos"])), F.lit(0)).alias("max_repos"),
    )


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every live credential replaced by ``mask``; common examples stay. The columns
    are those of ``docs``; ``n_chars``, where there is one, follows the text."""
    cols = docs.columns
    judged = scan(docs.select("doc_id", "text", "lang", "source")).where(F.size("live_at") > 0).select("__row", "live_at").dropDuplicates(["__row"])
    # spans of a text in order, each with where the ones before it have ended; what starts earlier is masked already
    spans = judged.select("__row", F.inline("live_at"))
    before = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    walked = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    gaps = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start"))))
    cuts = walked.groupBy("__row").agg(gaps.alias("__gaps"), F.max("end").alias("__last"))
    row = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), whole_text()))
    df = docs.withColumn("__row", row).join(cuts, "__row", "left").withColumnRenamed("__gaps", "__cut")
    df = df.withColumn("__blocks", F.when(F.col("__cut").isNotNull(), in_blocks(F.col("text"))))
    pieces = F.transform("__cut", lambda g: F.concat(from_blocks(F.col("__blocks"), g["from"], g["start"]), F.lit(mask)))
    rest = from_blocks(F.col("__blocks"), F.col("__last"), F.length("text").cast("long"))
    # the blocks are read here too: a column that only a lambda reads would be made anew for every piece
    clean = F.when(F.size("__blocks") > 0, F.concat(F.array_join(pieces, ""), rest))
    df = df.withColumn("text", F.coalesce(clean, F.col("text")))
    if "n_chars" in cols:
        df = df.withColumn("n_chars", F.when(F.col("__cut").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in cols])
