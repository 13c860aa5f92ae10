"""Secret scans: Boolean trigram queries against an inverted index pick the texts that each regex verifies."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_key, without_clash


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group that must have at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds in the order they are listed, then what this library adds.
BASE = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED


def trigram_query(pattern: str, most: int = 64) -> list[list[list[str]]]:
    """What a match must contain: an AND of clauses, each an OR of alternatives, each an AND of lower-cased trigrams.

    The pattern's fixed strings are multiplied out over alternations, optional parts and small classes, up
    to ``most`` strings; anything open ended closes the current strings as one clause. An empty query means
    that no trigram is mandatory and every text has to be scanned.
    """
    clauses: list[list[list[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            clauses.append(sorted([sorted({s[i:i + 3] for i in range(len(s) - 2)}) for s in strings]))

    def exact(node) -> set[str] | None:
        """All lower-cased strings that a node can match, or None if they are many."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN":
            if all(str(k) == "LITERAL" for k, _ in arg):
                return {chr(v).lower() for _, v in arg}
            return None
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "BRANCH":
            parts = [sequence(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op == "MAX_REPEAT" and arg[1] == 1:
            inner = sequence(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        if op == "MAX_REPEAT" and arg[0] == arg[1]:
            inner = sequence(arg[2])
            return None if inner is None or len(inner) ** arg[0] > most else {"".join(p) for p in product(inner, repeat=arg[0])}
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            e = exact(n)
            if e is None or len(out) * len(e) > most:
                return None
            out = {a + b for a in out for b in e}
        return out

    def walk(nodes) -> None:
        now: set[str] = {""}
        for n in nodes:
            e = exact(n)
            if e is None:
                close(now)
                now = {""}
                if str(n[0]) == "SUBPATTERN":
                    walk(n[1][3])
                elif str(n[0]) == "MAX_REPEAT" and n[1][0] > 0:
                    walk(n[1][2])
            elif len(now) * len(e) > most or (len(e) > 1 and min(map(len, now)) >= 3):
                close(now)
                now = e
            else:
                now = {a + b for a in now for b in e}
        close(now)

    walk(re._parser.parse(pattern))
    return clauses


def postings(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index, for the trigrams that the rules ask for: a row per trigram and document that contains it in any case."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for alternative in clause for g in alternative})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(F.col(id_col).alias("doc_id"), document_key(id_col, text).alias("key"), low.alias("low"))
    return d.select("doc_id", "key", F.explode(F.filter(F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>"),
                                                        lambda g: F.contains(F.col("low"), g))).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that meet the query of a rule: doc_id, key, kinds. Postings are intersected per document, never per trigram."""
    have = postings(docs, rules, id_col, text).groupBy("doc_id", "key").agg(F.collect_set("trigram").alias("have"))

    def met(rule: Rule) -> Column:
        out = F.lit(True)
        for clause in trigram_query(rule.pattern):
            any_of = F.lit(False)
            for alternative in clause:
                wanted = F.array(*map(F.lit, alternative))
                any_of = any_of | (F.size(F.array_intersect("have", wanted)) == len(alternative))
            out = out & any_of
        return out

    kinds = F.array_compact(F.array(*[F.when(met(r), F.lit(r.kind)) for r in rules if trigram_query(r.pattern)]))
    return have.select("doc_id", "key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as start and end in code points (end exclusive); those that fail the length are dropped.

    The text between the matches comes from splitting at them, so positions are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("len"), F.transform(judged, F.length).alias("size"))
    kind = "array<struct<start:int,end:int>>"
    walked = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.coalesce(p["len"], F.lit(0))).alias("at"),
            F.when(p["size"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["len"]).alias("end")))))
             .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(kind))


def _quick(rule: Rule) -> Rule:
    """The same spans from a pattern that only stops at runs long enough, where a match is one run of a class."""
    if rule.kind == "hex":
        return Rule("hex", "[0-9a-f]{%d,}" % rule.least)
    return rule


def _ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rule"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``found`` to every row: an array of (start, end, kind), by start and then by the order of the rules.

    Rules with a query look only at the candidates that the index gives; rules without one look at every
    text. Whole texts are searched; a null or empty text has nothing. Rows that repeat an id are told
    apart by their text, a null id is an id like others, a column named found is replaced, other columns
    stay as they are, and an empty table gives no rows.
    """
    d = without_clash(docs, "found").alias("d")
    c = candidates(docs, rules, id_col, text).alias("c")
    same = (F.xxhash64(F.col(f"d.{id_col}"), F.col(f"d.{text}")) == F.col("c.key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("c.doc_id"))
    body = F.coalesce(F.col(f"d.{text}"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    lists = []
    for n, rule in enumerate(rules):
        spans = spans_of(body, _quick(rule))
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(F.col("c.kinds"), rule.kind), spans).otherwise(none)
        lists.append(_ranked(spans, n, rule.kind))
    merged = F.array_sort(F.concat(*lists))
    found = F.transform(merged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return d.join(c, same, "left").select("d.*", found.alias("found"))


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every found span replaced by ``mask``; overlapping spans are replaced as one. Columns stay as they are,
    but for ``length``, which is counted anew in changed texts. Texts without secrets are untouched."""
    names = docs.columns
    s = scan(docs, rules, id_col, text)
    body = F.col(text)
    cut = F.aggregate(
        "found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    new = F.when(F.size("found") > 0, cut).otherwise(body)
    out = s.withColumn(text, new)
    if length and length in names:
        out = out.withColumn(length, F.when(F.size("found") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*[F.col(f"`{c}`") for c in names])
