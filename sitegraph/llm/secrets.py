"""Operator 9: secret scan through a trigram inverted index, DataFrame functions only.

From each rule's regex a Boolean trigram query is derived on the driver: an OR of
ANDs of trigrams that every match must hold (matched case-insensitively, so a
query can only let too many documents through).  The index holds, for every
trigram that some query names, the ids of the documents whose text has it; the
postings of a document are joined into one bit set, the queries are evaluated on
it (the intersection of their postings), and only documents that pass are
verified with the regex itself.  A rule with an alternative that has no mandatory
trigram scans every document.

Matches are leftmost and do not overlap within a rule.  Their places come from
the text's pieces between the matches: a match starts where the pieces and
matches before it end.  Places are code points, ends exclusive.

Skew: the index has one row per (trigram, document) and is grouped by document,
so frequent trigrams or sources make no large group.  Nothing is collected or
broadcast by the operator; the rules are literals of the plan.

Defined results: a null or empty text has no match; repeated documents get a row
each (rows with one id share the candidates, which are verified for each text);
null ids are joined as equal; an empty table gives an empty result; other
columns stay untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import fresh, read


@dataclass(frozen=True)
class Rule:
    """``kind`` names the rule.  A match whose ``group`` is shorter than ``least``
    is dropped (after it has taken its place among the matches)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Fixed by the query's contract.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Formats of well-known keys, as their issuers publish them.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: ``X+`` with a least length finds the same matches as ``X{least,}`` when X is one class,
#: and need not list the many short ones.
FASTER = {
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
SPAN = "struct<start:int,kind:int,end:int>"
MOST_ALTERNATIVES = 64


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i:i + 3] for i in range(len(literal) - 2))


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match of the regex holds, or
    None if some match may hold none (the rule scans everything)."""
    def joined(parsed) -> list[tuple[str, ...]]:
        """Alternatives of a sequence: the literal runs that are mandatory in each.
        Runs are kept apart where something optional or variable stands between."""
        alternatives: list[tuple[str, ...]] = [("",)]
        for op, value in parsed:
            if op is sre.LITERAL:
                alternatives = [(*a[:-1], a[-1] + chr(value).lower()) for a in alternatives]
                continue
            if op is sre.AT:
                continue
            if op is sre.SUBPATTERN:
                inner = joined(value[3])
            elif op is sre.BRANCH:
                inner = [x for branch in value[1] for x in joined(branch)]
            elif op is sre.IN and len(value) <= 8 and all(o is sre.LITERAL for o, _ in value):
                inner = [(chr(c).lower(),) for _, c in value]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
                inner = [(*x, "") for x in joined(value[2])] if value[:2] != (1, 1) else joined(value[2])
            else:
                inner = [("", "")]  # something, or nothing, that is not known
            if len(alternatives) * len(inner) > MOST_ALTERNATIVES:
                inner = [("", "")]
            alternatives = list(dict.fromkeys(
                (*a[:-1], a[-1] + i[0], *i[1:]) for a in alternatives for i in inner))
        return alternatives

    clauses = set()
    for runs in joined(sre_parser.parse(regex)):
        clause = frozenset().union(*map(trigrams, runs))
        if not clause:
            return None
        clauses.add(clause)
    # a clause that holds another one adds nothing to the OR
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def trigram_index(docs: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """The inverted index (trigram number, key) of the wanted trigrams."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i))
                                        for i, t in enumerate(wanted)]))
    return (docs.select(F.col(key).alias("key"), low.alias("low"))
            .select("key", F.explode(present).alias("trigram")))


def candidates(index: DataFrame, wanted: list[str], queries: dict[int, frozenset[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules, as a bit set, whose trigram query the postings of
    the key satisfy.  ``words`` 62-bit sets hold the trigrams of a key."""
    words = range((len(wanted) + 61) // 62)
    sets = index.groupBy("key").agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w,
                        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("trigram") % 62).cast("int")))
                 .otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words])
    place = {t: i for i, t in enumerate(wanted)}

    def holds(clause: frozenset[str]) -> Column:
        masks = dict.fromkeys(words, 0)
        for t in clause:
            masks[place[t] // 62] |= 1 << place[t] % 62
        parts = [F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    rules = F.lit(0)
    for number, clauses in sorted(queries.items()):
        passes = F.lit(False)
        for clause in sorted(clauses, key=sorted):
            passes = passes | holds(clause)
        rules = rules.bitwiseOR(F.when(passes, F.lit(1 << number)).otherwise(F.lit(0)))
    return sets.select("key", rules.alias("rules")).where("rules != 0")


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Column: array of SPAN, the rule's matches in order."""
    regex = F.lit(FASTER.get(rule.kind, rule.regex))
    found = F.regexp_extract_all(text, regex, F.lit(0))
    group = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, FASTER.get(rule.kind, rule.regex), -1)
    sizes = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(found)), found,
                                  lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))),
                       group, lambda s, g: F.struct(s["gap"].alias("gap"), s["size"].alias("size"),
                                                    F.length(g).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(number).alias("kind"),
                        (acc["at"] + s["gap"] + s["size"]).alias("end"))
        kept = F.when(s["part"] >= rule.least, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 rules: tuple[Rule, ...] = BASE + MORE) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): the spans of all
    rules, ordered by start, then rule."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    wanted = sorted({t for q in queries.values() for c in q for t in c})
    name = fresh(docs, "secret_spans")
    nothing = F.array().cast(f"array<{SPAN}>")
    body = F.coalesce(F.col(text), F.lit(""))
    if queries:
        own, bits = fresh(docs, "candidate_key"), fresh(docs, "candidate_rules")
        passed = candidates(trigram_index(docs, key, text, wanted), wanted, queries)
        passed = passed.select(F.col("key").alias(own), F.col("rules").alias(bits))
        rows = docs.join(passed, docs[key].eqNullSafe(F.col(own)), "left")
        able = F.coalesce(F.col(bits), F.lit(0))
    else:
        rows, able = docs, F.lit(0)
    parts = []
    for i, rule in enumerate(rules):
        test = F.rlike(body, F.lit(FASTER.get(rule.kind, rule.regex)))
        if i in queries:
            test = (able.bitwiseAND(F.lit(1 << i)) != 0) & test
        parts.append(F.when(test, rule_spans(body, rule, i)).otherwise(nothing))
    return rows.select(*[docs[c] for c in docs.columns], F.array_sort(F.concat(*parts)).alias(name)), name


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", by: str = "[SECRET]",
           rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The documents with every secret replaced by ``by`` (spans that touch or
    overlap are one).  Columns are those of ``docs``."""
    found, name = find_secrets(docs, key, text, rules)
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = (s["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], gap, F.lit(by))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(name), start, step,
                        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(body)).select(*docs.columns)


def joined_spans(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE + MORE
    found, name = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), rules=rules)
    spans = F.col("s")

    def count(kind: str) -> Column:
        number = [r.kind for r in rules].index(kind)
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return (found.select("doc_id", F.col(name).alias("s"))
            .select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(joined_spans(base, rules), 256).alias("base_sha256"),
                    joined_spans(spans, rules).alias("spans")))
