"""Secret scans: patterns over whole texts, judged by who else holds the same value, in DataFrame operations only.

Besides the base patterns, long tokens of mixed letters and digits are candidates. The hashes of all candidates' values
are aggregated over the corpus by distinct repositories and owners. A value that several owners or many repositories
hold is an example that was copied; one that few of either hold looks live, and a live-looking token is added to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import staged, whole

#: Kinds in their order, with pattern, number of the group that holds the value, and its least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("token", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]+", 0, 20),
)
#: The same kinds, in forms that are quick to rule out and miss none.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{20}|[A-Za-z+/_-]{65}"}
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, number: int) -> Column:
    """Spans of one kind: leftmost matches without overlap, those whose value is too short left out. Code points."""
    name, pattern, group, least = KINDS[number]
    # a run below the least length can't hold a passing match of these kinds, so it needn't be matched at all
    body = pattern if name == "assign" else f"{pattern[:-1]}{{{least - 4 if name == 'access' else least},}}"
    around = rf"(?s)\G(.*?)({body})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(around), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(around), F.lit(2)).alias("all"), F.regexp_extract_all(text, F.lit(around), F.lit(2 + group)).alias("value"))
    none = F.array().cast(SPAN)

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.length(m["all"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(HINTS[name]), spans).otherwise(none)


def _written(spans: Column, *more: str) -> Column:
    """kind:start:end, and ``more`` fields, by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), *(s[f].cast("string") for f in ("start", "end", *more)))), ",")


def scan_secrets(docs: DataFrame, *, owner: str = "source", repository: str = "doc_id", max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_added and holders for each row of ``docs``.

    ``owner`` and ``repository`` name the columns by which a value's holders are counted (null is a holder of its own).
    A value held by at most ``max_owners`` owners and at most ``max_repositories`` repositories counts as live, any other
    as copied; holders has kind:start:end:owners:repositories of every candidate. Tokens that overlap a base span aren't
    candidates. Null texts count as empty; repeated rows get equal results; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), whole(F.col("text")).alias("text"))
    spans = base.select("doc_id", "owner", "repository", F.concat(*(_spans(F.col("text"), k) for k in range(3))).alias("base"), _spans(F.col("text"), 3).alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"], F.length(s["value"])).alias("hash"))
    narrow = spans.select("doc_id", "owner", "repository", F.transform("base", hashed).alias("base"), F.transform(free, hashed).alias("tokens"))
    narrow = staged(narrow.withColumn("row", F.monotonically_increasing_id()), "spans")

    held = narrow.select("row", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("s")).select("row", "owner", "repository", F.col("s.hash").alias("hash"), F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    # counted in steps, each combined before it is shuffled: no value's holders meet in one task
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("holder")) for c in ("owner", "repository"))))
    apart = held.select("hash", sides.alias("h")).select("hash", "h.side", "h.holder").distinct()
    holders = apart.groupBy("hash").agg(F.count_if(F.col("side") == "owner").alias("owners"), F.count_if(F.col("side") == "repository").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = held.join(holders, "hash").select("row", "kind", "start", "end", "owners", "repositories", live.alias("live"))
    added = F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), F.struct("start", "kind", "end")))
    counted = F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))
    verdict = judged.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"), added.alias("added"), counted.alias("counted"))

    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    extra = F.coalesce("added", none)
    zero = F.lit(0).cast("long")
    return narrow.join(verdict, "row", "left").select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_written(plain), 256).alias("base_sha256"),
        _written(F.concat(plain, extra)).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_copied", zero).alias("n_copied"),
        F.size(extra).cast("long").alias("n_added"),
        F.coalesce(_written(F.col("counted"), "owners", "repositories"), F.lit("")).alias("holders"),
    )
