"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's expression is parsed into a Boolean trigram query: an OR of ANDs of trigrams that any match
must hold (lower-cased). One scan of the texts writes the index: for each rule trigram and segment (SEGMENT rows of
a file) the places of the rows that hold it. The postings of a query's trigrams are intersected segment by segment and
its alternatives united; the rows that remain are the rule's candidates, and only they are verified by the expression.
Rules without mandatory trigrams scan every text. Texts are never shuffled while the candidates' places (four bytes
each) are few enough to send to every task, which is checked; beyond, texts meet their segment's candidates in a join.
An index may be kept and used again for any rules whose trigrams it holds.

The base kinds are assign, access and hex; the others are added rules. Spans are in code points, end exclusive,
leftmost and non-overlapping within a kind. Defined results: null or empty text has no spans; null doc_ids and
repeated rows are scanned like any other (rows are told apart by their file and place in it); any number of matches in
a text takes time in proportion to it, but for a logarithm; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filed, numbered, read_table, written

#: A class or repeat that stands for more than this many strings is a gap in the literals around it.
CLASS, ALTERNATIVES = 8, 64
#: Rows of a file whose postings form one list.
SEGMENT = 1024
#: Candidate places that are sent to every task at most: 8 MB, and as much again for the segments' names.
SENT = 2_000_000


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (letters in either case where any_case is set) whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),  # a run of [0-9a-f]+ of that length
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# -- trigram queries


class _Reader:
    """The strings that an expression must hold. A way to match is a tuple of literal runs, of which the last is still
    open; whatever isn't spelled out closes a run. Marks of no width are passed over."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def ways(self, alts: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        while True:
            out += self.branch(alts)
            if self.peek() != "|":
                return list(dict.fromkeys(out)) if len(out) <= ALTERNATIVES else closed(alts)
            self.take()

    def branch(self, alts):
        while self.peek() not in ("", "|", ")"):
            start = self.at
            after = self.atom(alts)
            low, high = self.times()
            if (low, high) == (0, 1):
                both = [*alts, *after]
                alts = list(dict.fromkeys(both)) if len(both) <= ALTERNATIVES else closed(alts)
            elif (low, high) == (1, 1):
                alts = after
            else:
                stop = self.at
                for _ in range(min(low, 3)):
                    self.at = start
                    alts = self.atom(alts)
                self.at = stop
                alts = alts if low == high <= 3 else closed(alts)
        return alts

    def times(self) -> tuple[int, int | None]:
        c, out = self.peek(), (1, 1)
        if c and c in "?*+":
            out = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.take()]
        elif c == "{":
            stop = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : stop].partition(",")
            out = int(low or 0), (int(high) if high else None) if comma else int(low)
            self.at = stop + 1
        else:
            return out
        if self.peek() and self.peek() in "?+":  # lazy, possessive
            self.take()
        return out

    def atom(self, alts):
        c = self.take()
        if c == "(":
            return self.group(alts)
        if c == "[":
            return spelled(alts, self.members())
        if c in "^$":
            return alts
        return spelled(alts, self.escape() if c == "\\" else None if c == "." else [c])

    def group(self, alts):
        marks = ""
        if self.peek() == "?":
            while self.peek() not in (":", "=", "!", ">", ")", ""):
                marks += self.take()
            marks += self.take()
        if marks.endswith(")"):  # flags
            return alts
        inner = self.ways(alts)
        self.take()
        return alts if marks.endswith(("=", "!")) else inner

    def escape(self) -> list[str] | None:
        c = self.take()
        if c in "xu":
            n = 2 if c == "x" else 4
            self.at += n
            return [chr(int(self.text[self.at - n : self.at], 16))]
        if c in "bBAzZG":
            return []
        return [{"n": "\n", "r": "\r", "t": "\t", "f": "\f"}.get(c, c)] if c in "nrtf" or not c.isalnum() else None

    def members(self) -> list[str] | None:
        """The characters of a class, None for many."""
        out, many = [], self.peek() == "^"
        first = True
        while self.peek() != "]" or first:
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else [c]
            if not one:
                many = True
            elif self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                top = (self.escape() if c == "\\" else [c]) or one
                span = range(ord(one[0]), ord(top[0]) + 1)
                many |= len(span) > CLASS
                out += [] if many else map(chr, span)
            else:
                out += one
        self.take()
        return None if many or len(out) > CLASS else out


def closed(alts):
    return list(dict.fromkeys((*a, "") for a in alts))


def spelled(alts, chars: list[str] | None):
    """alts followed by one of chars: none of them if of no width, a gap if not spelled out."""
    if chars == []:
        return alts
    ways = [(*a[:-1], a[-1] + c) for a in alts for c in chars or ()]
    return ways if chars and len(ways) <= ALTERNATIVES else closed(alts)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Any match holds, lower-cased, all trigrams of one of these sets; [] if no trigrams are mandatory."""
    ways = _Reader(pattern).ways([("",)])
    sets = {frozenset(run[i : i + 3].lower() for run in way for i in range(len(run) - 2)) for way in ways}
    least = {s for s in sets if not any(o < s for o in sets)}
    return [] if frozenset() in sets else sorted(least, key=sorted)


# -- spans


def running(lengths: Column) -> Column:
    """Running sums of an array, by doubling: each step adds the sums that end a power of two before."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, lengths, lambda acc, step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0))))


SPANS = "array<struct<start:int,order:int,stop:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, stop) of one rule, from the pieces between its matches."""
    parts, matches = F.split(text, rule.java, -1), F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    value = lambda m: m if rule.group == 0 else F.regexp_extract(m, rule.java, rule.group)
    found = F.zip_with(running(lengths), matches, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), F.lit(order).alias("order"), stop.alias("stop"), (F.length(value(m)) >= rule.least).alias("long")))
    plain = F.transform(F.filter(found, lambda x: x["long"]), lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["stop"].alias("stop")))
    return F.when(text.rlike(rule.java), plain).otherwise(F.array().cast(SPANS))


# -- the index

PLACE = ("file", "twin", "segment")


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the segment and place in it of every row of docs, which filed() gave."""
    rows = numbered(docs, "__hl_row").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("__hl_row.*"))
    return rows.select("doc_id", "text", "file", "twin", F.floor(F.col("row") / SEGMENT).alias("segment"), (F.col("row") % SEGMENT).cast("int").alias("place"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: for each trigram of the rules and segment, the places of the rows that hold it."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) for g in s})
    low = placed(docs).withColumn("low", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    each = low.select(*PLACE, "place", F.explode(held).alias("gram"))
    return each.groupBy("gram", *PLACE).agg(F.collect_list("place").alias("places"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each segment with any, the candidates of each rule: rules, a map of its number to places."""
    needs = [(k, a, g, len(s)) for k, r in enumerate(rules) for a, s in enumerate(trigram_query(r.pattern)) for g in sorted(s)]
    terms = index.sparkSession.createDataFrame(needs, "rule int, alternative int, gram string, size int")
    met = index.join(F.broadcast(terms), "gram").groupBy(*PLACE, "rule", "alternative").agg(F.collect_list("places").alias("lists"), F.first("size").alias("size"))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    some = met.where(F.size("lists") == F.col("size")).select(*PLACE, "rule", both.alias("places")).where(F.size("places") > 0)
    united = some.groupBy(*PLACE, "rule").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return united.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("rule", "places"))).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """doc_id and `found`, an array of spans (start, order, stop) sorted by start and rule, for every row."""
    docs = filed(docs)
    texts = placed(docs)
    known = {k for k, r in enumerate(rules) if trigram_query(r.pattern)}
    if known:
        index = written(postings(docs, rules), "trigrams") if index is None else index
        chosen = written(candidates(index, rules), "candidates")
        places = chosen.agg(F.sum(F.aggregate(F.map_values("rules"), F.lit(0), lambda acc, x: acc + F.size(x)))).first()[0] or 0
        texts = texts.join(F.broadcast(chosen) if places <= SENT else chosen, list(PLACE), "left")
    own = lambda k: F.coalesce(F.array_contains(F.element_at("rules", F.lit(k)), F.col("place")), F.lit(False))
    each = [F.when(own(k), spans(F.col("text"), r, k)).otherwise(F.array().cast(SPANS)) if k in known else spans(F.col("text"), r, k) for k, r in enumerate(rules)]
    return texts.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["order"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("found", lambda x: x["order"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    return found.select(
        "doc_id",
        *[of(k) for k in base],
        F.sha2(shown(F.filter("found", lambda x: x["order"].isin(base))), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read_table(spark, sf_dir, "documents")))
