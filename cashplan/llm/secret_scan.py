"""Secret scans over every version of every file, by an incremental blob ledger. DataFrame functions only.

A version's text is addressed by its SHA-256. The ledger holds, for each blob and each version of each rule, the spans
found, none included. A scan looks up which (blob, rule, rule version) pairs the ledger lacks, runs those rules over one
copy of each such blob, adds the findings to the ledger, and joins the ledger back to all paths.

Spans are found with two functions that Spark has: the matches, and what lies between them. Their lengths, added up, are
the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashplan.session import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose group is too short are dropped after."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}:{self.version}"


# The base rules, in the order in which spans of one start are listed.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: Further rules; their spans are listed after the base ones of the same start.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: Steps from match to match that running sums take in a row.
STEPS_AT_ONCE = 128
_SPANS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob binary, findings array<struct<rule:string,version:int,spans:{_SPANS}>>"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob``, ``text`` and the rules ``due`` to ledger rows."""
    none = F.array().cast("array<string>")
    due = {rule: F.array_contains("due", rule.key) for rule in rules}
    out = blobs.withColumns(
        {
            f"match_{rule.name}": F.when(
                due[rule], F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
            ).otherwise(none)
            for rule in rules
        }
    )
    some = {rule: F.size(f"match_{rule.name}") > 0 for rule in rules}
    out = out.withColumns(
        {f"gap_{rule.name}": F.when(some[rule], F.split("text", rule.pattern, -1)).otherwise(none) for rule in rules}
        | {
            f"group_{rule.name}": F.when(
                some[rule], F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
            ).otherwise(none)
            for rule in rules
            if rule.group
        }
    ).drop("text")
    findings = [
        F.when(
            due[rule],
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.version).alias("version"),
                _spans(rule).alias("spans"),
            ),
        )
        for rule in rules
    ]
    return out.select("blob", F.array_compact(F.array(*findings)).alias("findings"))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: a lambda's argument is a value, while a
    column named within a lambda is worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def _spans(rule: Rule) -> Column:
    """The spans of a rule's matches: places are running sums of the lengths of gaps and matches.

    An array that grows by one element is copied each time, so sums run over chunks of steps first, and then within
    each chunk.
    """
    matches, gaps = F.col(f"match_{rule.name}"), F.col(f"gap_{rule.name}")
    kept = F.col(f"group_{rule.name}") if rule.group else matches
    lengths = F.transform(
        F.arrays_zip(matches.alias("match"), gaps.alias("gap"), kept.alias("kept")),
        lambda step: F.struct(
            F.length(step["gap"]).alias("gap"),
            F.coalesce(F.length(step["match"]), F.lit(0)).alias("length"),
            F.coalesce(F.length(step["kept"]) >= rule.least, F.lit(False)).alias("keep"),
        ),
    )  # what follows the last match is a gap too; it has no match and is not kept

    def chunked(steps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(STEPS_AT_ONCE))
        return F.transform(starts, lambda at: F.slice(steps, at, STEPS_AT_ONCE))

    def length_of(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda done, step: done + step["gap"] + step["length"])

    def places(chunks: Column) -> Column:
        """Where each chunk starts, and where the last one ends."""
        zero = F.array(F.lit(0))
        return F.aggregate(
            F.transform(chunks, length_of), zero, lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
        )

    def add(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        stop = start + step["length"]
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        spans = F.when(step["keep"], F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    def spans_of(placed: Column) -> Column:
        empty = F.struct(placed["at"].alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.when(placed["chunk"].isNull(), F.array().cast(_SPANS)).otherwise(
            F.aggregate(placed["chunk"], empty, add, lambda done: done["spans"])
        )

    def of_chunks(chunks: Column) -> Column:
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), places(chunks).alias("at")), spans_of))

    return _with(lengths, lambda steps: _with(chunked(steps), of_chunks))


def new_findings(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Ledger rows for the (blob, rule, rule version) pairs of ``versions`` (``text``) that ``ledger`` lacks.

    A null text is the empty blob. A text that many rows share is moved once per task and scanned once. With a ledger, only
    hashes are compared with it; then the texts of the blobs that are due are moved, and no others where the list of these is
    small enough for Spark to broadcast it.
    """
    keys = F.array(*(F.lit(rule.key) for rule in rules))
    addressed = versions.select(_text().alias("text")).withColumn("blob", _blob(F.col("text")))
    if ledger is None:
        blobs = addressed.groupBy("blob").agg(F.first("text").alias("text"))
        return _scanned(blobs.withColumn("due", keys), rules)
    known = (
        ledger.select("blob", F.explode("findings").alias("found"))
        .groupBy("blob")
        .agg(F.collect_set(F.concat_ws(":", "found.rule", F.col("found.version").cast("string"))).alias("known"))
    )
    missing = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
    hashes = addressed.select("blob").distinct().join(known, "blob", "left").select("blob", missing.alias("due"))
    due = written(hashes.where(F.size("due") > 0))
    blobs = addressed.join(due.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    return _scanned(blobs.join(due, "blob"), rules)


def _is_of(rule: Rule):
    return lambda span: span["rule"] == rule.name


def by_path(
    versions: DataFrame, ledger: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """What the ledger has of each version: its path, counts of the rules' spans, and the spans as text."""
    current = F.array(*(F.lit(rule.key) for rule in rules))

    def is_current(found: Column) -> Column:
        key = F.concat_ws(":", found["rule"], found["version"].cast("string"))
        return F.array_contains(current, key) & (F.size(found["spans"]) > 0)

    of_blob = (
        ledger.select("blob", F.filter("findings", is_current).alias("findings"))
        .where(F.size("findings") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))  # two writers may have found the same
    )
    order = F.create_map(*(x for i, rule in enumerate(rules) for x in (F.lit(rule.name), F.lit(i))))
    base = F.array(*(F.lit(rule.name) for rule in BASE))
    spans = F.flatten(
        F.transform(
            "findings",
            lambda found: F.transform(
                found["spans"],
                lambda span: F.struct(
                    span["start"].alias("start"),
                    order[found["rule"]].alias("order"),
                    span["stop"].alias("stop"),
                    found["rule"].alias("rule"),
                ),
            ),
        )
    )

    def listed(some: Column) -> Column:
        return F.array_join(
            F.transform(some, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["stop"].cast("string"))),
            ",",
        )

    listing = (
        of_blob.withColumn("all", F.array_sort(spans))
        .withColumns(
            {
                f"n_{rule.name}": F.size(F.filter("all", _is_of(rule))).cast("long")
                for rule in rules
            }
            | {
                "base": listed(F.filter("all", lambda s: F.array_contains(base, s["rule"]))),
                "spans": listed(F.col("all")),
            }
        )
        .drop("all", "findings")
    )
    # a table of its own, so that the partition of a blob with very many paths can be split when it is joined
    listing = written(listing)
    paths = versions.select(F.col(path), _blob(_text()).alias("blob"))
    counts = [F.coalesce(f"n_{rule.name}", F.lit(0).cast("long")).alias(f"n_{rule.name}") for rule in rules]
    return paths.join(listing, "blob", "left").select(
        path,
        *counts[: len(BASE)],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *counts[len(BASE) :],
    )


def scan(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: ``doc_id`` (its path), ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, then the
    counts of the further rules.

    Reads ``doc_id`` and ``text`` only. With ``ledger_path`` the ledger in that folder is read, if there is one, and
    added to; without, the scan starts with an empty ledger, kept in the shared folder for this scan. A null text is empty;
    repeated rows each come back; ids may be null; an empty table gives an empty one. Texts of any length are scanned whole, in
    time that grows with their length and their matches. Places count code points.
    """
    versions = versions.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ledger_path is None:
        ledger = written(new_findings(versions, None, rules))
    else:
        new_findings(versions, read_ledger(versions.sparkSession, ledger_path), rules).write.mode("append").parquet(
            ledger_path
        )
        ledger = versions.sparkSession.read.schema(LEDGER).parquet(ledger_path)
    return by_path(versions, ledger, "doc_id", rules)


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger in a folder; None where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return None
        raise
