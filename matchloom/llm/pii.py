"""Personal data by candidate gradient boosting (native: DataFrame functions only).

Base spans: email, ip, card and phone by pattern and check. High-recall generators propose further, overlapping spans of
the same kinds in forms that the base patterns miss. Boosted trees of depth two score a span by its format and its
context. There are no labels, so they learn from disguises: every base span is rewritten in the forms of `DISGUISES` and
put back into its own context (24 signs before it, one after it) as a positive; proposals that touch no base span of
their kind are the negatives, so real data in disguise count as such too and only lower the precision that is measured.
The trees are fitted outside the calibration fold, a fifth of the documents, from one table of counts by feature values,
whose size is bounded by the product of the features' ranges (8,640 rows). On the calibration fold a threshold per kind
is set where precision is at least `precision` over at least 20 spans; without that, a kind adds nothing. Proposals above
it that touch no base span are added, leftmost first; an ip or a card must also pass its parts' or Luhn check.

Proposed cards have 12 to 23 digits, proposed phones 2 to 6 groups of digits; parts of mails and addresses have any length.

Null text: empty. A text without a span has zero counts, an empty list and the hash of the empty string. Positions are
code points, ends exclusive. Rows are scored one by one, so repeated rows and extra columns do not matter; very long texts are
taken whole, in time near linear in their length and number of hits (added spans: hits to the power 1.5). An empty table, or one without base spans, adds nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Look-behinds and possessive repeats find the same leftmost matches without
# trying again inside a run of characters; \G allows a match to begin where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?: ?(?:[.,:]|\[\.\]|\[dot\]|\(dot\)) ?[0-9]++){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,22}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,6}\)?){1,5}(?![0-9A-Za-z])",
}
#: How a base span is rewritten into forms that only the generators propose: steps of (pattern, replacement) in turn.
DISGUISES = {
    "email": [[("@", " (at) "), (r"\.(?=[A-Za-z0-9-]+$)", " (dot) ")], [("@", "[at]"), (r"\.(?=[A-Za-z0-9-]+$)", "[dot]")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", " . ")]],
    "card": [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1.")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1/")]],
    "phone": [[(r"^\+", "")], [(r"^\+", "00")]],
}
#: Words that stand before personal data, as patterns.
CUES = {
    "email": r"(?i)(mail|write|contact|adress|address|correo|courriel)",
    "ip": r"(?i)(ip\b|host|server|node|addr|login)",
    "card": r"(?i)(card|visa|master|amex|credit|karte|carte|tarjeta|iban)",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|whatsapp|handy)",
}
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits in c pass the Luhn check."""
    d = F.reverse(F.filter(F.split(digits(c), ""), lambda x: x != ""))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(c: Column) -> Column:
    parts = F.filter(F.split(c, "[^0-9]+"), lambda x: x != "")
    return F.forall(parts, lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("long"), F.lit(999)) <= 255))


def accepted(kind: str, c: Column) -> Column:
    n = F.length(digits(c))
    checks = {"email": lambda: F.lit(True), "ip": lambda: octets(c), "card": lambda: n.between(16, 19) & luhn(c), "phone": lambda: n.between(8, 15)}
    return checks[kind]()


#: How many signs before a span are its context, and how many lengths are summed one by one.
CONTEXT, CHUNK = 24, 64


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def chunks(items: Column, size) -> Column:
    """An array cut into arrays of so many items."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it: chunks first, then numbers of a chunk. No state holds more than a number, as
    Spark copies the state of an aggregate at every step."""
    def inside(part, start):
        return F.transform(part, lambda x, j: start + total(F.slice(part, 1, j)))

    def of(parts):
        return let(F.transform(parts, total), lambda whole: F.flatten(F.transform(parts, lambda part, i: let(total(F.slice(whole, 1, i)), lambda start: inside(part, start)))))

    return let(numbers, lambda a: let(chunks(a, CHUNK), of))


def leftmost(spans: Column) -> Column:
    """Of spans in order, each that begins where no taken one goes on; a text's state is refolded from the starts of about
    as many chunks as a chunk has spans."""
    until = lambda at, x: F.when(x["s"] >= at, x["e"]).otherwise(at)

    def inside(part, start):
        free = F.transform(part, lambda x, j: F.struct((x["s"] >= F.aggregate(F.slice(part, 1, j), start, until)).alias("free"), x.alias("x")))
        return F.transform(F.filter(free, lambda y: y["free"]), lambda y: y["x"])

    def of(a, size):
        return F.flatten(F.transform(chunks(a, size), lambda part, i: let(F.aggregate(F.slice(a, 1, i * size), F.lit(0), until), lambda start: inside(part, start))))

    return let(spans, lambda a: let(F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1)), lambda size: of(a, size)))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches (s, e, m) with the signs before them (left) and the one after (after)."""
    last = lambda c: F.substring(c, -CONTEXT, CONTEXT)

    def pieces(both):
        m, g = both["found"], both["gaps"]
        after = lambda i: F.substring(F.concat(F.get(g, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))), 1, 1)
        return F.transform(m, lambda x, i: F.struct(x.alias("m"), F.char_length(F.get(g, i)).alias("g"), F.char_length(x).alias("n"), last(F.get(g, i)).alias("gap"), last(F.concat(F.get(g, i), x)).alias("last"), after(i).alias("after")))

    def placed(st, at):
        # A match has two signs at least, so half as many pieces as the context has signs are enough.
        before = lambda i: F.transform(F.slice(st, F.greatest(i - CONTEXT // 2 + 1, F.lit(1)), F.least(i, F.lit(CONTEXT // 2))), lambda y: y["last"])
        s = lambda x, i: F.get(at, i) + x["g"]
        return F.transform(st, lambda x, i: F.struct(s(x, i).alias("s"), (s(x, i) + x["n"]).alias("e"), x["m"].alias("m"), last(F.concat(F.array_join(before(i), ""), x["gap"])).alias("left"), x["after"].alias("after")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    spans = let(let(found, pieces), lambda st: let(sums_before(F.transform(st, lambda x: x["g"] + x["n"])), lambda at: placed(st, at)))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,left:string,after:string>>"))


def touches(w: Column, spans: Column) -> Column:
    """Whether w overlaps one of spans, which are in order and don't overlap: the last that begins before w ends, by binary search."""
    powers = F.slice(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), 32 - F.length(F.bin(F.size(spans))), F.length(F.bin(F.size(spans))))
    further = lambda n, p: (n + p <= F.size(spans)) & (F.get(spans, n + p - 1)["s"] < w["e"])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(further(n, p), n + p).otherwise(n), lambda n: (n > 0) & (F.get(spans, n - 1)["e"] > w["s"]))


def _features(kind: str, m: Column, x: Column) -> list[Column]:
    """Small integers: kind 0-3, separators 0-4, length class 0-5, Luhn or octets 0-1, cue before 0-1, left and right neighbour 0-2 each, repeated digits 0-1; of a span m that stands where the match x does."""
    left, before, after = x["left"], F.substring(x["left"], -1, 1), x["after"]
    side = lambda c: F.when(c.rlike(r"^[\s.,;:!?)\"']?$"), 0).when(c.rlike("^[0-9A-Za-z]$"), 1).otherwise(2)
    n = F.length(digits(m))
    kinds_of = F.array_distinct(F.filter(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""), lambda c: c != ""))
    return [
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.size(kinds_of), F.lit(4)).alias("seps"),
        F.when(n < 8, 0).when(n < 10, 1).when(n < 13, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5).alias("size"),
        (F.when(octets(m), 1).otherwise(0) if kind == "ip" else F.when(luhn(m), 1).otherwise(0) if kind == "card" else F.lit(0)).alias("valid"),
        F.when(left.rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
        side(before).alias("left"),
        side(after).alias("right"),
        F.when(m.rlike(r"([0-9])\1{4}"), 1).otherwise(0).alias("same"),
    ]


FEATURES = ("kind", "seps", "size", "valid", "cue", "left", "right", "same")


def boost(cells: list[dict], rounds: int = 12, rate: float = 0.4, smooth: float = 1.0) -> tuple[float, list]:
    """Gradient boosting with trees of depth two on weighted cells (n rows, pos of them positive). Newton leaves."""
    pos, n = sum(c["pos"] for c in cells), sum(c["n"] for c in cells)
    start = math.log((pos + 1) / (n - pos + 1))
    f = [start] * len(cells)
    cuts = [(k, v) for k in FEATURES for v in sorted({c[k] for c in cells})[1:]]

    def best(rows, g, h):
        def score(part):
            return sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + smooth)

        found = []
        for k, v in cuts:
            low = [i for i in rows if cells[i][k] < v]
            if 0 < len(low) < len(rows):
                high = [i for i in rows if cells[i][k] >= v]
                found.append((score(low) + score(high), k, v, low, high))
        return max(found, key=lambda x: (x[0], x[1], x[2]), default=None)

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in f]
        g = [c["pos"] - c["n"] * q for c, q in zip(cells, p)]
        h = [c["n"] * q * (1 - q) for c, q in zip(cells, p)]

        def grow(rows, depth):
            cut = best(rows, g, h) if depth else None
            if cut is None:
                leaf = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + smooth)
                for i in rows:
                    f[i] += leaf
                return leaf
            return (cut[1], cut[2], grow(cut[3], depth - 1), grow(cut[4], depth - 1))

        trees.append(grow(list(range(len(cells))), 2))
    return start, trees


def margin(start: float, trees: list, get) -> Column:
    def of(t):
        return F.lit(float(t)) if not isinstance(t, tuple) else F.when(get(t[0]) < t[1], of(t[2])).otherwise(of(t[3]))

    out = F.lit(start)
    for t in trees:
        out = out + of(t)
    return out


def value(start: float, trees: list, cell: dict) -> float:
    out = start
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if cell[t[0]] < t[1] else t[3]
        out += t
    return out


def _disguised(kind: str, x: Column) -> list[Column]:
    """A base span in each disguise, with its features where it stands, null if the generator does not propose that form."""
    out = []
    for steps in DISGUISES[kind]:
        m = x["m"]
        for pattern, new in steps:
            m = F.regexp_replace(m, pattern, new)
        out.append(F.when(m.rlike(f"^(?:{WIDE[kind]})$"), F.struct(*_features(kind, m, x))))
    return out


def spans(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """Per document: doc_id, base (array of kind, s, e), extra (the method's own spans, likewise)."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5).alias("fold"), t.alias("t"))

    def base_of(kind):
        return F.filter(matches(F.col("t"), BASE[kind], NEEDS[kind]), lambda x: accepted(kind, x["m"]))

    def wide_of(k, kind):
        found = matches(F.col("t"), WIDE[kind], NEEDS[kind])
        return F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *_features(kind, x["m"], x)[1:]))

    def placed(kind):
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def positives(kind):
        return F.filter(F.flatten(F.transform(kind, lambda x: F.array(*_disguised(kind, x)))), lambda x: x.isNotNull())

    each = list(enumerate(KINDS))
    found = rows.select("doc_id", "fold", "t", *[base_of(kind).alias(kind) for kind in KINDS], F.concat(*[wide_of(k, kind) for k, kind in each]).alias("wide"))
    # Only ids, spans and features are kept; the text is read once.
    kept = stored(found.select("doc_id", "fold", *[placed(kind).alias(kind) for kind in KINDS], "wide", F.concat(*map(positives, KINDS)).alias("disguised")))
    of_kind = lambda w: [(w["k"] == k) & touches(w, F.col(kind)) for k, kind in each]
    plain = F.filter("wide", lambda w: ~reduce(or_, of_kind(w)))
    no = kept.select("fold", F.explode(plain).alias("w")).select("fold", F.col("w.k").alias("kind"), *[F.col(f"w.{c}").alias(c) for c in FEATURES[1:]], F.lit(0).alias("good"))
    yes = kept.select("fold", F.explode("disguised").alias("w")).select("fold", *[F.col(f"w.{c}").alias(c) for c in FEATURES], F.lit(1).alias("good"))
    cells = no.unionByName(yes).withColumn("fold", F.col("fold") == 0)
    cells = [r.asDict() for r in cells.groupBy("fold", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("pos")).collect()]
    cells.sort(key=lambda c: [c[k] for k in ("fold", *FEATURES)])
    start, trees = boost([c for c in cells if not c["fold"]])
    least = []
    for k in range(len(KINDS)):
        held = sorted(((value(start, trees, c), c["n"], c["pos"]) for c in cells if c["fold"] and c["kind"] == k), reverse=True)
        limit, n, pos = math.inf, 0, 0
        for i, (v, a, b) in enumerate(held):
            n, pos = n + a, pos + b
            if pos >= precision * n and n >= 20 and (i + 1 == len(held) or held[i + 1][0] < v):
                limit = v
        least.append(limit)
    clear = lambda w: ~reduce(or_, [touches(w, F.col(kind)) for kind in KINDS])
    score = lambda w: margin(start, trees, lambda c: w["k" if c == "kind" else c])
    extra = F.filter("wide", lambda w: (score(w) >= F.element_at(F.array(*map(F.lit, least)), w["k"] + 1)) & clear(w) & (~w["k"].isin(1, 2) | (w["valid"] == 1)))
    extra = F.array_sort(F.transform(extra, lambda w: F.struct(w["s"].alias("s"), (-w["e"]).alias("r"), w["k"].alias("k"))))
    extra = leftmost(F.transform(extra, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["r"]).alias("e"))))
    named = lambda k, kind: F.transform(kind, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    base = F.concat(*[named(k, kind) for k, kind in each])
    return kept.select("doc_id", base.alias("base"), extra.alias("extra"))


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; time grows with a text's length times its spans."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    t = F.coalesce("text", F.lit(""))
    cut = F.aggregate(
        F.array_sort(F.transform("_all", lambda x: F.struct(x["s"], x["e"], x["k"]))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.element_at(names, x["k"] + 1)).alias("out"))).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))),
    )
    both = docs.join(found.select("doc_id", F.concat("base", "extra").alias("_all")), "doc_id")
    return both.withColumn("text", F.when(F.col("text").isNotNull(), cut)).drop("_all")


def digest(docs: DataFrame) -> DataFrame:
    found = spans(docs)

    def n_of(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    count = [n_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))
