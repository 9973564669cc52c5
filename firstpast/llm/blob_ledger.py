"""Secret scans over a ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger,
a Parquet table in a shared folder, has rows ``(blob, rules, spans, covers)``: the
rule versions that were applied to a blob, what they found, and all versions applied to it by then. A scan takes the blobs of which some current rule version is missing, one copy of each, and
applies the missing ones only. A scan passes over the history with one anti join on blob
and covers; only rows of the blobs it takes are grouped. Texts in which no rule's cheap test finds anything are marked
without being moved. Marks and findings are in one row and one commit,
so a scan that dies leaves nothing half done and the next one starts over. Findings
are joined back to all paths that have, or ever had, the blob.

All of it is built-in functions. A rule's matches and what lies between them (``regexp_extract_all``
and ``split`` by the same pattern) give the places of the matches by adding up lengths.

Defined cases: NULL counts as the empty text; repeated rows and copies share a
blob and get a result each; an empty table makes an empty ledger; a blob of which
a rule finds nothing is marked too. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import unused
from firstpast.session import materialize, working_path

SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = {"blob": "binary", "rules": "array<string>", "spans": SPANS, "covers": "array<string>"}


def either_case(word: str) -> str:
    """Classes for the letters of a word, so that only ASCII letters match."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern, the strings one of which a text must hold (none: it is always tried), and a test of a match."""

    kind: str
    pattern: str
    version: int = 1
    holds: tuple[str, ...] = ()
    # A match stands if this group of the pattern has at least so many characters.
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def maybe(self, text: Column) -> Column:
        """A cheap test that a text with a match passes."""
        found = [F.contains(text, F.lit(s)) for s in self.holds]
        return text.rlike(self.pattern) if not found else found[0] if len(found) == 1 else sum_or(found)

    def spans(self, text: Column) -> Column:
        matches = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        between = F.split(text, self.pattern, -1)
        steps = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"))
        def step(so_far: Column, at: Column) -> Column:
            start = so_far["at"] + F.length(at["gap"])
            end = start + F.length(at["match"])
            one = F.array(F.struct(F.lit(self.name).alias("rule"), start.alias("start"), end.alias("end")))
            stands = F.lit(True) if not self.least else (
                F.length(F.regexp_extract(at["match"], self.pattern, self.group)) >= self.least)
            found = F.when(stands, F.concat(so_far["found"], one.cast(SPANS))).otherwise(so_far["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
        return F.when(self.maybe(text), F.aggregate(steps, start, step, lambda end: end["found"])).otherwise(
            F.array().cast(SPANS))


def sum_or(tests: Sequence[Column]) -> Column:
    total = tests[0]
    for test in tests[1:]:
        total = total | test
    return total


KEYWORDS = ("password", "passwd", "secret", "token")
# The rules that a report counts.
BASE = (
    Rule("assign", "(" + "|".join(map(either_case, KEYWORDS)) + f"|{either_case('api')}_?{either_case('key')})"
         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}", holds=("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}"),
)
# What follows a key's first line. Line ends may be written out (\n), headers come first. Up to the last line all
# but a hyphen belongs to the key; of a key cut off, whatever goes on as base64 and space from 16 characters of it on.
# Loops over single classes only: they take no stack, and the checking engine has no possessive ones.
_KEY_BODY = (
    r"(?:[\t\r\n\x20\\nr]*[A-Z][A-Za-z-]{0,30}:\x20?[A-Za-z0-9,-]+){0,8}"
    r"(?:[^-]*-----END [A-Z ]{0,20}PRIVATE KEY-----|[\t\r\n\x20\\nr]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\t\r\n\x20\\]*)?")
# Well-known shapes of keys beyond those.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + _KEY_BODY, 2, holds=("PRIVATE KEY-----",)),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", holds=("eyJ",)),
    Rule("forge_token", "gh[opusr]_[A-Za-z0-9]{36,}", holds=("gho_", "ghp_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", holds=("xox",)),
    Rule("url_login", r"[a-z]{2,12}://[^\s/:@]+:[^\s/@]{3,}@", 2, holds=("://",)),
)
RULES = BASE + MORE


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _applied(ledger: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rule versions that these blobs had."""
    rows = ledger.select("blob", "rules").join(blobs, "blob", "left_semi")
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Apply what is missing to the texts and return the ledger; a ledger that is not there is begun."""
    spark = docs.sparkSession
    nothing = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in LEDGER.items()])
    nothing.write.mode("append").parquet(ledger)
    past = spark.read.schema(nothing.schema).parquet(ledger)
    wanted = F.array(*[F.lit(r.name) for r in rules])
    said = F.coalesce(text, F.lit(""))
    # Only texts in which some rule may find something are moved; of the others the address is enough.
    versions = docs.select(
        blob(F.col(text)).alias("blob"), F.when(sum_or([r.maybe(said) for r in rules]), said).alias("content"))
    none = F.array().cast("array<string>")
    if past.isEmpty():
        todo = versions.dropDuplicates(["blob"]).withColumn("had", none)
    else:
        full = past.where(F.size(F.array_except(wanted, F.coalesce("covers", "rules"))) == 0).select("blob")
        fresh = versions.join(full, "blob", "left_anti").dropDuplicates(["blob"])
        had = _applied(past, fresh.select("blob"))
        todo = fresh.join(had, "blob", "left").withColumn("had", F.coalesce("had", none))
    # Scans that ran at the same time may have covered a blob by several rows.
    todo = todo.withColumn("missing", F.array_except(wanted, "had")).where(F.size("missing") > 0)
    content = F.col("content")
    found = F.concat(*[
        F.when(F.array_contains("missing", r.name), r.spans(content)).otherwise(F.array().cast(SPANS)) for r in rules])
    todo.select(
        "blob", F.col("missing").alias("rules"), found.alias("spans"), F.array_union("had", "missing").alias("covers")).write.mode("append").parquet(ledger)
    return spark.read.schema(nothing.schema).parquet(ledger)


def _in_order(rules: Sequence[Rule]) -> Callable[[Column, Column], Column]:
    """Compares spans by start, then by the place of their rule in the list."""
    place = F.array(*[F.lit(r.name) for r in rules])

    def compare(a: Column, b: Column) -> Column:
        first = a["start"] - b["start"]
        return F.when(first != 0, first).otherwise(
            F.array_position(place, a["rule"]) - F.array_position(place, b["rule"])).cast("int")

    return compare


def found_blobs(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs in which these rule versions found something, in order of place."""
    names = [r.name for r in rules]
    spans = F.array_distinct(F.flatten(F.collect_list(F.filter("spans", lambda s: s["rule"].isin(names)))))
    ordered = F.transform(
        F.array_sort("spans", _in_order(rules)),
        lambda s: F.struct(F.substring_index(s["rule"], "@", 1).alias("rule"), s["start"].alias("start"),
                           s["end"].alias("end")))
    return (ledger.where(F.size("spans") > 0).groupBy("blob").agg(spans.alias("spans"))
            .where(F.size("spans") > 0).select("blob", ordered.alias("spans")))


def _scanned(docs: DataFrame, ledger: str | None, rules: Sequence[Rule], text: str) -> DataFrame:
    ledger = ledger or working_path(docs.sparkSession, "ledger")
    return materialize(found_blobs(scan(docs, ledger, rules, text), rules), "found-blobs")


def findings(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text",
             key: str = "doc_id") -> DataFrame:
    """``(key, spans)`` of every row; without a ledger's folder a new one is begun in the shared folder."""
    found = _scanned(docs, ledger, rules, text)
    paths = docs.select(F.col(key), blob(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select(
        key, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def report(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """Counts and a digest of the base rules' spans, and all spans, of every row."""
    of = findings(docs, ledger, rules, text, key)
    def among(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["rule"].isin(*kinds))

    base = among(*(r.kind for r in BASE))
    counts = [F.size(among(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return of.select(key, *counts, F.sha2(_written(base), 256).alias("base_sha256"),
                     _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES, text: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """The rows with all their columns; spans in the text, overlapping ones as one, become the mark."""
    name, places = unused(docs, "blob_of_text"), unused(docs, "spans_of_blob")
    found = _scanned(docs, ledger, rules, text).select(F.col("blob").alias(name), F.col("spans").alias(places))
    both = docs.withColumn(name, blob(F.col(text))).join(found, name, "left")
    said = F.col(text)

    def step(so_far: Column, s: Column) -> Column:
        before = F.concat(so_far["out"], F.substring(said, so_far["at"] + 1, s["start"] - so_far["at"]), F.lit(mark))
        return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= so_far["at"], before).otherwise(so_far["out"]).alias("out"))

    clean = F.aggregate(places, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda end: F.concat(end["out"], F.substring(said, end["at"] + 1, F.length(said))))
    return both.select(*[
        F.when(F.col(places).isNotNull(), clean).otherwise(said).alias(c) if c == text else F.col(c)
        for c in docs.columns])


# -- the same for a checking engine ----------------------------------------------

def check_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``report`` over the table ``documents``."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        test = f"length(regexp_extract(hit, {pattern}, {rule.group})) >= {rule.least}" if rule.least else "true"
        parts.append(f"""
  SELECT n, {k} AS place, '{rule.kind}' AS kind, start, start + length(hit) AS stop FROM (
    SELECT n, m[i] AS hit, list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT n, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT n, regexp_extract_all(said, {pattern}) AS m, string_split_regex(said, {pattern}) AS g
      FROM d WHERE regexp_matches(said, {pattern})))) WHERE {test}""")
    union = " UNION ALL ".join(parts)
    base = len(BASE)
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    one = "concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS said FROM documents),
s AS ({union})
SELECT doc_id, {counts},
       sha256(coalesce(string_agg({one}, ',' ORDER BY start, place) FILTER (WHERE place < {base}), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY start, place) FILTER (WHERE place IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (n) GROUP BY n, doc_id"""
