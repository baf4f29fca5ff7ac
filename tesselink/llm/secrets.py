"""Secret scans over an incremental ledger of blobs.

Every version of a document is named by the SHA-256 of its text, its blob.  The ledger holds the findings of each
(blob, rule, rule version) that was ever scanned, also when there were none.  A scan drops the pairs that the
ledger has, takes one row for each blob that is left, scans its text once by the rules due, and joins the
findings back to all documents and versions with that blob.  ``advance`` gives the ledger after a scan, ``report``
the findings of a ledger; ``scan`` does both at once.

Which rules are due is settled on ids and blobs alone.  Texts stay where they are as long as the rows that depart
from the most common case (all rules due at first, none in a later run) are few enough to broadcast; beyond that
they are joined by shuffle.  The same holds for the findings.

Spans are code point offsets, end exclusive.  They come from the lengths of the matches and of the gaps that
splitting at the same pattern leaves; their prefix sums are taken in blocks, so that time stays near linear.

Defined cases: null text counts as empty; matches of a rule do not overlap and are leftmost; spans are ordered by
start, then by the order of ``RULES``, then end; repeated rows each get the findings; an empty table gives an empty
result; a null id is joined like any value; further columns pass through, whatever their names, except those that a
function adds (blob and spans).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, others, packed, unpacked


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    #: A match counts if this group (0: all of it) has at least so many characters.
    group: int = 0
    least: int = 0


#: Fixed values; the order of kinds is that of the spans.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
)
#: A private key from its header to its END line or, without one, through the lines of base64 that follow; repeats are
#: bounded where the matcher recurses.
_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:(?:[^-]++|-(?!----)){0,400}+-{5,}END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
    r"|(?:[\s\\]*+(?:Proc-Type|DEK-Info):[^\n]*+){0,9}+(?:[\s\\\"']*+[A-Za-z0-9+/=_]{16,}+){0,1000}+(?:\s*\n[A-Za-z0-9+/=_]{1,15}(?=\s*(?:\n|$)))?)"
)
#: ``RULES`` with whole private keys, for redaction.
WHOLE = tuple(replace(r, pattern=_KEY, version=2) if r.kind == "pem" else r for r in RULES)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,kind:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"
_BLOCK = 256
#: Rows (an id and a blob, or a blob and its spans; spans count as rows) that are broadcast at most.
BROADCAST_ROWS = 100_000


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often and however deep the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(steps: Column, use) -> Column:
    """``use`` of (x, i) -> start of match i; ``steps`` has each match's gap before it and length."""
    block_of = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = lambda moves: F.transform(F.sequence(F.lit(0), block_of(F.size(moves) - 1)), lambda b: _add(F.slice(moves, b * _BLOCK + 1, F.lit(_BLOCK))))
    ahead = lambda blocks: F.transform(blocks, lambda x, b: _add(F.slice(blocks, F.lit(1), b)))
    return _let(F.transform(steps, lambda x: x["gap"] + x["len"]), lambda moves: _let(sums(moves), lambda blocks: _let(ahead(blocks), lambda before: use(
        lambda x, i: F.get(before, block_of(i)) + _add(F.slice(moves, block_of(i) * _BLOCK + 1, i % _BLOCK)) + x["gap"]))))


def _spans(text: str, number: int, rule: Rule) -> Column:
    """Spans of a rule in the column ``text``."""
    col = F.col(text)
    counts = F.lit(True) if not rule.least else None
    match, gaps = F.regexp_extract_all(col, F.lit(rule.pattern), 0), F.split(col, rule.pattern, -1)

    def step(m, g):
        enough = counts if counts is not None else F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
        return F.struct(F.coalesce(F.length(g), F.lit(0)).alias("gap"), F.length(m).alias("len"), enough.alias("counts"))

    def spans(steps):
        return _starts(steps, lambda start: F.transform(steps, lambda x, i: F.struct(start(x, i).alias("start"), F.lit(number).alias("kind"), (start(x, i) + x["len"]).alias("end"), x["counts"].alias("counts"))))

    # The gap after the last match has no match; it is left out.
    pairs = F.zip_with(match, gaps, step)
    found = _let(pairs, lambda all_: _let(F.slice(all_, F.lit(1), F.size(all_) - 1), spans))
    kept = F.transform(F.filter(found, lambda x: x["counts"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.when(col.rlike(rule.pattern), kept).otherwise(F.array().cast(SPANS))


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _due(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(path, blob, due) of the distinct rows of ``paths``: a bit for each rule that is due at this row.

    The smallest path of a blob stands for it; nothing is due at the others.
    """
    one = paths.groupBy("blob").agg(F.min("path").alias("first"))
    if ledger is None:
        due = one.withColumn("due", F.lit((1 << len(rules)) - 1))
    else:
        seen = ledger.groupBy(F.col("blob").alias("of")).agg(F.collect_set(F.struct("rule", "version")).alias("seen"))  # as many as there are rule versions
        had = lambda r: F.coalesce(F.array_contains("seen", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))), F.lit(False))
        bits = [F.when(had(r), 0).otherwise(1 << k) for k, r in enumerate(rules)]
        due = one.join(seen, F.col("blob") == F.col("of"), "left").select("blob", "first", sum(bits[1:], bits[0]).alias("due"))
    due = due.withColumnRenamed("blob", "one")
    at = (F.col("blob") == F.col("one")) & F.col("path").eqNullSafe(F.col("first"))
    return paths.distinct().join(due, at, "left").select("path", "blob", F.coalesce("due", F.lit(0)).alias("due"))


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows (``LEDGER``) of the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks."""
    paths = durable(docs.select(F.col(id_col).alias("path"), blob(F.col(text_col)).alias("blob")))
    due = durable(_due(paths, ledger, rules))
    cases = sorted(due.groupBy("due").count().collect(), key=lambda r: (-r["count"], r["due"]))  # at most one for each set of rules
    usual, rest = (cases[0]["due"] if cases else 0), sum(r["count"] for r in cases[1:])
    texts = docs.select(F.col(id_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"), blob(F.col(text_col)).alias("blob"))
    other = due.select(F.col("path").alias("due_path"), F.col("blob").alias("due_blob"), "due")
    at = (F.col("blob") == F.col("due_blob")) & F.col("path").eqNullSafe(F.col("due_path"))
    if rest <= BROADCAST_ROWS:
        known = texts.join(F.broadcast(other.where(F.col("due") != usual)), at, "left") if rest else texts.withColumn("due", F.lit(None).cast("int"))
        unseen = known.withColumn("due", F.coalesce("due", F.lit(usual)))
    else:
        unseen = texts.join(other.where("due <> 0"), at)
    unseen = unseen.where("due <> 0")
    for k, r in enumerate(rules):
        unseen = unseen.withColumn(f"s{k}", F.when(F.col("due").bitwiseAND(1 << k) != 0, _spans("text", k, r)))
    found = unseen.select("blob", F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.col(f"s{k}").alias("spans")) for k, r in enumerate(rules)]).alias("all"))
    # Rows that repeat id and text were scanned together; a pair is written once.
    return found.select("blob", F.explode("all").alias("x")).select("blob", "x.rule", "x.version", "x.spans").where("spans is not null").distinct()


def advance(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger after a scan of ``docs``, cut from its lineage; to be kept for the next one."""
    fresh = scan_blobs(docs, ledger, rules, id_col=id_col, text_col=text_col)
    return durable(fresh if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(fresh))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(found_blob, spans) of the blobs with findings under the given rule versions, spans in order."""
    valid = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule")).cast("int") - 1
    hits = ledger.where((F.size("spans") > 0) & (valid[F.col("rule")] == F.col("version"))).withColumn("number", number)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("number").alias("kind"), s["end"].alias("end")))
    return hits.groupBy(F.col("blob").alias("found_blob")).agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def _with_findings(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (a column blob) with the spans of their blobs, null where there are none."""
    hits = durable(findings(ledger, rules))
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans")).first()
    few = size["n"] + (size["spans"] or 0) <= BROADCAST_ROWS
    return rows.join(F.broadcast(hits) if few else hits, F.col("blob") == F.col("found_blob"), "left").drop("found_blob")


def report(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``blob`` and the ``spans`` that the ledger has for it (empty where it has none)."""
    own = others(docs, text_col, "blob", "spans")
    rows = docs.select(packed(own).alias("own"), blob(F.col(text_col)).alias("blob"))
    return _with_findings(rows, ledger, rules).select(*unpacked("own", own), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``blob`` and ``spans`` (empty where nothing was found); what ``ledger`` has is not scanned again."""
    return report(docs, _known(docs, ledger, rules, id_col, text_col), rules, text_col=text_col)


def _known(docs, ledger, rules, id_col, text_col):
    fresh = scan_blobs(docs, ledger, rules, id_col=id_col, text_col=text_col)
    return fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "version", "spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; ``length_col``, if given, follows.

    Under ``RULES`` a private key loses its header only; ``WHOLE`` takes its body too.
    """
    rows = docs.select(packed(docs.columns).alias("row"), blob(F.col(text_col)).alias("blob"))
    rows = _with_findings(rows, _known(docs, ledger, rules, id_col, text_col), rules)
    text = F.col("row").getField(text_col)
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"))
    clean = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    hit = F.col("spans").isNotNull()
    rows = rows.withColumn("clean", F.when(hit, clean).otherwise(text))
    named = {text_col: F.col("clean")} | ({length_col: F.when(hit, F.length("clean").cast("long")).otherwise(F.col("row").getField(length_col))} if length_col else {})
    return rows.select(*[named.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
