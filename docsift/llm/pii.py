"""Personal data: candidates by generous patterns, judged by gradient boosted trees.

All is done with DataFrame functions, in one pass without a shuffle.

1. Base spans are the matches of fixed patterns that pass their checks (octets, number of
   digits, Luhn). They always stay.
2. Generators propose further, overlapping spans of each kind: addresses spelt with (at)
   and (dot), numbers of a card's length with any separators, telephone numbers without a
   plus, IPv6.
3. Boosted trees give each proposal a probability from its format and its context. They
   are trained on the candidates of at most about ``TRAIN_DOCS`` documents (chosen by a hash
   of their text). There are no labels for spans, so the base checks label them:
   passing spans and respelt copies of them are positive, candidates that touch
   no base span are negative.
4. On held-out candidates each kind gets the lowest threshold at which ``PRECISION`` of
   the accepted are positive; a kind without one adds nothing. The fitted trees become a
   column expression.
5. Proposals above it are added, of two that overlap the more probable.

Positions are code points, the end exclusive. Null and empty texts have no spans.
Repeated rows and null ids are judged like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 20_000
LEAST_ROWS = 40
PRECISION = 0.98
CONTEXT = 24

# The patterns of the contract, in a form that needs no backtracking over long runs and matches the same: a run is only
# entered at its start or where the last match ended, and is never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {
    "email": f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++\\.[A-Za-z0-9-]++(?:(?:\\.[A-Za-z0-9-]++){{1,50}}+)*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
GENERATORS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[a-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?i)(?<![0-9a-f.:])(?:[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}|[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7})(?![0-9a-f.:])",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ().-]{0,2}[0-9]){8,14}(?![0-9])",
}
#: Every candidate of a generator has this, also of the base pattern of cards; texts without it are passed over.
HINTS = {
    "email": r"@|(?i:[(\[{]at[)\]}])",
    "ip": r"[0-9] ?\.|[0-9a-fA-F]:",
    "card": "[0-9][ .-]{0,2}[0-9]",
    "phone": r"[0-9][ ().-]{0,2}[0-9]",
}
CUES = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|fax|mobile|whatsapp",
}


def located(text: Column, pattern: str) -> Column:
    """Matches as array of (start, value): between them lie the parts that the pattern splits off."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["g"]
        one = F.array(F.struct(start.alias("start"), x["m"].alias("value")))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(done["out"], one).alias("out"))

    return F.aggregate(both, none, step, lambda done: done["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    turned = F.reverse(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step)
    return (F.length(number) > 0) & F.when(F.length(number) > 0, total % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: passes(kind, s["value"]))


def _of_kind(no: int, spans: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == no)


def _typed(no: int, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind"), (s["start"] + F.length(s["value"])).alias("stop"), s["value"].alias("value")
        ),
    )


_SPAN = "struct<start:int,kind:int,stop:int,value:string>"
_SPANS = f"array<{_SPAN}>"
_SCORED = f"array<struct<s:{_SPAN},p:double>>"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``: the base spans as (start, kind, stop, value), sorted."""
    own = F.coalesce(F.col(text), F.lit(""))
    for no, kind in enumerate(KINDS):
        here = F.contains(own, F.lit(NEEDS[kind])) if NEEDS[kind] else own.rlike(HINTS[kind])
        docs = docs.withColumn(f"_{kind}", F.when(here, located(own, BASE[kind])))
    parts = []
    for no, kind in enumerate(KINDS):
        parts.append(F.coalesce(_typed(no, _passing(kind, F.col(f"_{kind}"))), F.array().cast(_SPANS)))
    docs = docs.withColumn("_base", F.array_sort(F.concat(*parts)))
    return docs.drop(*(f"_{kind}" for kind in KINDS))


def _masked(text: str) -> Column:
    """The text with base spans blanked out, so that no generator's match touches one."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        stop = F.greatest(done["at"], s["stop"])
        gap = F.substring(F.col(text), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.repeat(F.lit("\u0001"), F.greatest(stop - F.greatest(done["at"], s["start"]), F.lit(0)))
        return F.struct(stop.alias("at"), F.concat(done["out"], F.array(gap, mark)).alias("out"))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(F.col(text), done["at"] + 1, F.length(text)))

    return F.when(F.size("_base") > 0, F.aggregate("_base", none, step, finish)).otherwise(F.coalesce(F.col(text), F.lit("")))


def with_proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_proposed``: the generators' spans, none of which touches a base span."""
    docs = docs.withColumn("_masked", _masked(text))
    own = F.col("_masked")
    for kind in KINDS:
        docs = docs.withColumn(f"_{kind}", F.when(own.rlike(HINTS[kind]), located(own, GENERATORS[kind])))
    parts = [F.coalesce(_typed(no, F.col(f"_{kind}")), F.array().cast(_SPANS)) for no, kind in enumerate(KINDS)]
    return docs.withColumn("_proposed", F.concat(*parts)).drop("_masked", *(f"_{kind}" for kind in KINDS))


def features(span: Column, text: Column) -> Column:
    """Format and context of a span as array<double>."""
    value, kind = span["value"], span["kind"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    last = F.substring(text, F.greatest(span["start"], F.lit(1)), F.least(span["start"], F.lit(1)))
    after = F.substring(text, span["stop"] + 1, F.lit(1))
    number = digits(value)
    cue = F.lit(False)
    for no, kind_name in enumerate(KINDS):
        cue = cue | ((kind == no) & F.lower(before).rlike(CUES[kind_name]))
    listed = [
        *(kind == no for no in range(len(KINDS))),
        F.length(value),
        F.length(number),
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        (kind == 2) & luhn(number),
        (kind == 1) & value.rlike(f"^{_OCTET}(?: ?\\. ?{_OCTET}){{3}}$"),
        value.rlike(r"^\+|^00"),
        value.rlike(r"\([0-9]{2,4}\)"),
        value.rlike("[0-9]{3,4}[ .-][0-9]{3,4}[ .-]?[0-9]*$"),
        value.rlike(r"(?i)@|[(\[{]at[)\]}]"),
        F.length(F.regexp_extract(value, "([A-Za-z]*)$", 1)),
        cue,
        last.rlike("[A-Za-z0-9]"),
        after.rlike("[A-Za-z0-9]"),
        F.lower(before).rlike("(?:token|key|hash|id|no|isbn|version|v)[. ]?[=:\"' ]*$"),
    ]
    return F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in listed))


def _respelt(span: Column) -> Column:
    """A positive span as it might be written without matching the base pattern."""
    value, number = span["value"], digits(span["value"])
    spelt = F.replace(F.replace(value, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) "))
    quads = F.regexp_replace(number, "([0-9]{4})(?=[0-9])", "$1.")
    bare = F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]?", "")
    other = F.when(span["kind"] == 0, spelt).when(span["kind"] == 1, F.replace(value, F.lit("."), F.lit(" . ")))
    other = other.when(span["kind"] == 2, quads).otherwise(F.when(F.length(digits(bare)) > 8, bare).otherwise(value))
    return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["stop"].alias("stop"), other.alias("value"))


@dataclass(frozen=True)
class Model:
    """Trees as (feature, threshold, left, right) or leaf value, and a threshold for each kind."""

    trees: tuple = ()
    thresholds: tuple = (None,) * len(KINDS)

    def probability(self, values: Column) -> Column:
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + _expression(tree, values)
        return 1.0 / (1.0 + F.exp(-2.0 * total))

    def accepts(self, kind: Column, probability: Column) -> Column:
        good = F.lit(False)
        for no, threshold in enumerate(self.thresholds):
            if threshold is not None:
                good = good | ((kind == no) & (probability >= threshold))
        return good


def _expression(tree, values: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(values[feature] <= threshold, _expression(left, values)).otherwise(_expression(right, values))


def _nodes(node, weight: float):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction()) * weight
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _nodes(node.leftChild(), weight), _nodes(node.rightChild(), weight)


def training_rows(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``kind, values, label, held_out`` of the candidates of a sample of documents."""
    n = docs.count()
    part = F.pmod(F.xxhash64(text), F.lit(1 << 20)) < max(1, min(1 << 20, (train_docs << 20) // max(n, 1)))
    own = with_proposals(with_base(docs.select(F.col(text).alias("text")).where(part)))
    rows = F.concat(
        F.transform("_base", lambda s: F.struct(s.alias("s"), F.lit(1).alias("label"))),
        F.transform("_base", lambda s: F.struct(_respelt(s).alias("s"), F.lit(1).alias("label"))),
        F.transform("_proposed", lambda s: F.struct(s.alias("s"), F.lit(0).alias("label"))),
    )
    own = own.where("size(_base) + size(_proposed) > 0").select("text", F.explode(rows).alias("r"))
    held_out = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    return own.select(F.col("r.s.kind").alias("kind"), features(F.col("r.s"), F.col("text")).alias("values"), F.col("r.label").alias("label"), held_out.alias("held_out"))


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Model:
    rows = stored(training_rows(docs, text, train_docs), "pii-training")
    vectors = rows.withColumn("features", array_to_vector("values")).withColumn("label", F.col("label").cast("double"))
    train = vectors.where("not held_out")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST_ROWS:
        return Model()
    fitted = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=11, featuresCol="features", labelCol="label").fit(train.coalesce(4))
    trees = tuple(_nodes(t._call_java("rootNode"), w) for t, w in zip(fitted.trees, fitted.treeWeights))
    judged = fitted.transform(vectors.where("held_out")).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    bins = judged.groupBy("kind", F.floor(F.col("p") * 50).alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    found: list[float | None] = [None] * len(KINDS)
    by_kind: dict[int, list] = {}
    for r in bins.collect():
        by_kind.setdefault(r["kind"], []).append((r["bin"], r["good"], r["n"]))
    for kind, own in by_kind.items():
        good = total = 0
        for at, g, n in sorted(own, reverse=True):
            good, total = good + g, total + n
            if total >= 10 and good >= precision * total:
                found[kind] = at / 50
    return Model(trees, tuple(found))


def with_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and added), each sorted by start and kind."""
    docs = with_base(docs, text)
    if not model.trees or not any(t is not None for t in model.thresholds):
        return docs.withColumn("_spans", F.col("_base"))
    docs = with_proposals(docs, text)
    own = F.coalesce(F.col(text), F.lit(""))
    scored = F.transform("_proposed", lambda s: F.struct(s.alias("s"), model.probability(features(s, own)).alias("p")))
    docs = docs.withColumn("_scored", F.when(F.size("_proposed") > 0, scored))
    docs = docs.withColumn("_scored", F.array_sort(F.filter("_scored", lambda c: model.accepts(c["s"]["kind"], c["p"]))))
    none = F.array().cast(_SCORED)

    def keep(done: Column, c: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        apart = last.isNull() | (last["s"]["stop"] <= c["s"]["start"])
        instead = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(c))
        return F.when(apart, F.concat(done, F.array(c))).when(c["p"] > last["p"], instead).otherwise(done)

    added = F.transform(F.coalesce(F.aggregate("_scored", none, keep), none), lambda c: c["s"])
    return docs.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop("_proposed", "_scored")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def pii_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """For each row ``doc_id``, the number of base spans of each kind, ``base_sha256`` and ``spans``."""
    docs = docs.select("doc_id", "text")
    found = with_spans(docs, fit(docs) if model is None else model)
    numbers = [F.size(_of_kind(no, "_base")).cast("long").alias(f"n_{k}") for no, k in enumerate(KINDS)]
    return found.select("doc_id", *numbers, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping ones by one mark."""
    columns = docs.columns
    # the row in one column, so that none of its names meets one that is used here
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text").alias("text"))
    found = with_spans(docs, fit(docs) if model is None else model)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        more = F.when(s["start"] >= done["at"], F.array(gap, names[s["kind"]])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.concat(done["out"], more).alias("out"))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substring(F.col("text"), done["at"] + 1, F.length("text")))

    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", none, step, finish)).otherwise(F.col("text"))
    return found.select(*((clean if c == "text" else F.col("row")[c]).alias(c) for c in columns))
