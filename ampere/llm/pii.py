"""Personal data: candidate spans judged by boosted trees.

High-recall patterns propose overlapping spans of four kinds; those of the
base patterns that pass their checks always count. The others (spelled-out
addresses, other separators, missing prefixes) are judged by gradient-boosted
trees over the span's format and context. They learn from the corpus's own
base spans, respelled and moved into other contexts: the check that a span
passes tells nothing about the label. Thresholds are calibrated per kind.
DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampere.llm.tables import staged

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in forms that never backtrack over a long run: a local
# part or number is entered at its first character, or where the last match
# ended (\G), and runs are possessive.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Further shapes that people write; bounded repeats.
LOOSE = {
    "email": r"(?i)(?<![\w.%+-])[\w.%+-]{1,64}+(?: ?[(\[{<] ?at ?[)\]}>] ?| @ ?|@ )[\w-]{1,63}"
             r"(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]) ?[\w-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/ -]{1,3}[0-9]{4}){2}[._/ -]{1,3}[0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# What a text must hold for a pattern to be tried.
GATES = {
    ("base", "email"): lambda t: t.contains("@"),
    ("base", "ip"): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("base", "card"): lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    ("base", "phone"): lambda t: t.contains("+"),
    ("loose", "email"): lambda t: t.rlike(r"(?i)[(\[{<] ?at ?[)\]}>]| @|@ "),
    ("loose", "ip"): lambda t: t.rlike(r"[0-9](?:\[\.\]|\(\.\)| ?\. ?)[0-9]"),
    ("loose", "card"): lambda t: t.rlike(r"[0-9]{4}[._/ -]{1,3}[0-9]{4}"),
    ("loose", "phone"): lambda t: t.rlike(r"[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}"),
}
# Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|host|address|server)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|amex|credit|payment)\W*\w*\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell)\W*\w*\W*$",
}
# Words before a span that speak against personal data: numbers of versions, parts, pages, prices, dates and the like.
DENIED = (r"(?i)\b(?:version|ver|release|build|firmware|section|sec|chapter|figure|fig|table|page|line|step|item|serial|isbn|issn|part|model|sku|"
          r"order|invoice|ref|reference|batch|lot|doi|case|rates?|prices?|costs?|total|sum|score|ratio|size|range|dates?|year|between|"
          r"clause|article|paragraph|rule|exercise|equation|meet|meeting|lunch|tickets?|shares?)\b\W*(?:\w{1,8}\W+){0,2}$")
# Contexts that training spans are moved into, by kind and then in general; what follows a longer number.
SPOKEN_BY = {
    "email": ["mail me at ", "Contact: ", "please write to ", "reach us: ", "e-mail "],
    "ip": ["IP address ", "host: ", "the server ", "from address ", "ip "],
    "card": ["card number ", "Visa: ", "credit card: ", "payment by card ", "amex "],
    "phone": ["phone: ", "call ", "Tel. ", "fax ", "mobile: "],
}
DENIED_BY = {
    "email": ["meet us ", "tickets ", "lunch ", "prices ", "shares ", "meeting "],
    "ip": ["version ", "section ", "see chapter ", "release ", "firmware ", "clause "],
    "card": ["serial ", "order ", "part no. ", "invoice ", "batch ", "reference "],
    "phone": ["rates were ", "serial ", "ISBN ", "part no. ", "dates ", "order ", "scores between "],
}
GOES_ON = ["-77", "-4 and", ".5 or", "-1234", "/12", " %"]
#: last labels of addresses that people write; two letters may be a country's
DOMAINS = ("com|org|net|edu|gov|mil|int|info|biz|io|app|dev|name|museum|example|test|local|co|me|tv|"
           "de|fr|es|it|nl|uk|eu|ch|at|be|pl|pt|se|no|fi|dk|ie|ru|us|ca|au|nz|br|mx|in|cn|jp|kr|za")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LEFT, _RIGHT = 24, 8


@dataclass(frozen=True)
class PiiParams:
    """``max_rows``: labelled rows that the trees are fitted on at most, the
    same number for each kind (None: all rows); ``even_rows``: a kind with
    more rows than these to learn from weighs as much as these, so that no
    kind outweighs the others, and each of its rows the same; ``precision``:
    share of true spans asked of a kind's threshold."""

    max_rows: int | None = None
    even_rows: int = 4_000
    trees: int = 15
    depth: int = 4
    precision: float = 0.95
    seed: int = 7


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, with positions in
    code points: the gaps between matches and the matches add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("match"), F.split(text, pattern, -1).alias("gap"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), _no_spans("match").alias("spans"))
    matches = F.filter(pairs, lambda pair: pair["match"].isNotNull())  # the gap after the last match has none
    return F.aggregate(matches, begin, step, lambda acc: acc["spans"])


def _no_spans(name: str) -> Column:
    """An empty array of ``start, end, <name>``."""
    return F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias(name))), 1, 0)


def _tagged(spans: Column, shape: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        F.lit(shape == "base").alias("base")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def plain(kind: Column, match: Column) -> Column:
    """A span without its spelling: what the checks look at."""
    spelled = F.regexp_replace(F.regexp_replace(match, r"(?i) ?[(\[{<] ?at ?[)\]}>] ?| @ ?|@ ", "@"),
                               r"(?i) ?[(\[{<] ?dot ?[)\]}>] ?| ?\. ?", ".")
    return (F.when(kind == "email", spelled)
            .when(kind == "ip", F.regexp_replace(match, r"[^0-9.]", ""))
            .otherwise(F.regexp_replace(match, r"[^0-9]", "")))


def checked(kind: Column, value: Column) -> Column:
    """Does the plain value pass its kind's check?"""
    digits = F.char_length(F.regexp_replace(value, r"[^0-9]", ""))
    card = F.when(digits.between(13, 19), F.call_function("luhn_check", value)).otherwise(F.lit(False))
    return (F.when(kind == "email", value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))
            .when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == "card", card)
            .otherwise(digits.between(9, 15)))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, start, end, match, before, after, base``:
    every proposed span whose value passes its kind's check, once per document
    text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("_digit", F.col("text").rlike("[0-9]")).where(F.col("_digit") | F.col("text").contains("@") | F.col("text").rlike(r"(?i)[(\[{<] ?at ?[)\]}>]"))
    names = []
    for shape, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            gate = GATES[shape, kind](F.col("text"))
            if kind != "email":
                gate = F.col("_digit") & gate
            rows = rows.withColumn(f"{shape}_{kind}", F.when(gate, located(F.col("text"), pattern)))
            names.append((shape, kind))
    tagged = [_tagged(F.coalesce(F.col(f"{shape}_{kind}"), _no_spans("match")), shape, kind) for shape, kind in names]
    rows = rows.withColumn("span", F.explode(F.concat(*tagged))).withColumn("text_hash", F.xxhash64("text"))
    start, end = F.col("span.start"), F.col("span.end")
    rows = rows.select(
        "doc_id", "text_hash", "span.kind", "span.start", "span.end", "span.match", "span.base",
        F.substring("text", F.greatest(start - _LEFT, F.lit(0)) + 1, F.least(start, F.lit(_LEFT))).alias("before"),
        F.substring("text", end + 1, F.lit(_RIGHT)).alias("after"))
    passes = checked(F.col("kind"), plain(F.col("kind"), F.col("match")))
    # a base match fixes its own place: it counts as base if it passes
    return rows.where(F.coalesce(passes, F.lit(False))).groupBy("doc_id", "text_hash", "kind", "start", "end").agg(
        F.first("match").alias("match"), F.first("before").alias("before"), F.first("after").alias("after"), F.max("base").alias("base"))


FEATURES = ["kind_no", "chars", "digits", "letters", "spaces", "hyphens", "dots", "brackets", "ats", "groups", "domain",
            "digit_before", "letter_before", "digits_near", "assigned", "money", "letter_after", "goes_on", "spoken", "denied"]


def with_features(spans: DataFrame) -> DataFrame:
    """Format features of ``match`` and context features of ``before`` and ``after``."""
    m, before, after, kind = F.col("match"), F.col("before"), F.col("after"), F.col("kind")
    count = lambda c, keep: F.char_length(F.regexp_replace(c, f"[^{keep}]", ""))
    spoken = F.lit(False)
    for k, pattern in CONTEXT.items():
        spoken = F.when(kind == k, before.rlike(pattern)).otherwise(spoken)
    number = F.lit(0)
    for i, k in enumerate(KINDS):
        number = F.when(kind == k, F.lit(i)).otherwise(number)
    values = {
        "kind_no": number, "chars": F.char_length(m), "digits": count(m, "0-9"), "letters": count(m, "A-Za-z"), "spaces": count(m, " "),
        "hyphens": count(m, r"/_-"), "dots": count(m, "."), "brackets": count(m, r"()\[\]{}<>"), "ats": count(m, "@"),
        "groups": F.size(F.split(m, r"[^0-9A-Za-z]+")), "domain": m.rlike(rf"(?i)[^A-Za-z](?:{DOMAINS})$"),
        "digit_before": before.rlike("[0-9]$"), "letter_before": before.rlike(r"\p{L}$"),
        "digits_near": count(before, "0-9"), "assigned": before.rlike(r"[=:#\"'] ?$"), "money": before.rlike(r"[$€£¥] ?$"),
        "letter_after": after.rlike(r"^\p{L}"), "goes_on": after.rlike(r"^(?:[-./ ]?[0-9]| ?%)"), "spoken": spoken, "denied": before.rlike(DENIED),
    }
    spans = spans.withColumns({k: v.cast("double") for k, v in values.items()})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(spans)


def training_rows(spans: DataFrame, p: PiiParams) -> DataFrame:
    """``kind, match, before, after, label, mark``: all distinct base spans,
    each in nine versions; with ``max_rows`` as many of each kind at most
    (smallest hashes first).

    True: as it stands, respelled plainly (brackets, dashes) in its own context
    and after words that speak for its kind, and respelled loosely (spaces)
    after such words. False: both spellings after words that speak against
    it, the loose one in plain prose (a card's check is strong enough to stay
    true), a number that goes on, and for addresses another domain.
    """
    versions = 9
    of_kind = spans.where("base").groupBy("kind", "match", "before", "after").agg(F.lit(1)).withColumn("mark", F.xxhash64("kind", "match", "before", "after"))
    # few bytes but much work per row: dealt to all cores, where AQE would leave one task
    own = of_kind.repartition(spans.sparkSession.sparkContext.defaultParallelism, "mark") if p.max_rows is None else None
    for k in KINDS if p.max_rows is not None else ():
        part = of_kind.where(F.col("kind") == k).orderBy("mark", "match", "before", "after").limit(max(1, p.max_rows // len(KINDS) // versions))
        own = part if own is None else own.unionAll(part)
    kind, match, before, after = F.col("kind"), F.col("match"), F.col("before"), F.col("after")
    pick = lambda words, salt: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("mark", F.lit(salt)), F.lit(len(words))).cast("int"))
    either = lambda x, y: F.when(F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(2)) == 0, x).otherwise(y)

    def by_kind(of: dict[str, Column]) -> Column:
        out = of[KINDS[-1]]
        for k in KINDS[:-1]:
            out = F.when(kind == k, of[k]).otherwise(out)
        return out

    digits = F.regexp_replace(match, "[^0-9]", "")
    ten = lambda form: F.regexp_replace(digits, "^.*([0-9]{3})([0-9]{3})([0-9]{4})$", form)
    fours = lambda sep: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    dotted = F.regexp_replace(F.regexp_replace(match, "@", " (at) "), r"\.", " (dot) ")
    plainly = by_kind({"email": either(dotted, F.regexp_replace(match, "@", " [at] ")),
                       "ip": either(F.regexp_replace(match, r"\.", "[.]"), F.regexp_replace(match, r"\.", "(.)")),
                       "card": either(fours(". "), fours("/")), "phone": either(ten("$1-$2-$3"), ten("($1) $2-$3"))})
    loosely = by_kind({"email": either(F.regexp_replace(match, "@", " @ "), F.regexp_replace(match, "@", "@ ")),
                       "ip": F.regexp_replace(match, r"\.", " . "), "card": fours("  "), "phone": either(ten("$1 $2 $3"), ten("$1.$2.$3"))})
    local, host = F.regexp_extract(match, "^(.*)@", 1), F.regexp_extract(match, "@(.*)$", 1)
    other = F.concat(F.regexp_replace(local, "[^A-Za-z]", ""), F.lit(" @ "), either(F.reverse(host), F.regexp_replace(digits, "^.*(..)(..)$", "$1.$2")))
    said = F.concat(F.right(before, F.lit(8)), by_kind({k: pick(SPOKEN_BY[k], 2) for k in KINDS}))
    against = F.concat(F.right(before, F.lit(6)), F.lit(" "), by_kind({k: pick(DENIED_BY[k], 3) for k in KINDS}))
    prose = F.regexp_replace(before, "(?i)(?:mail|contact|write|reach|ip|host|address|server|card|visa|amex|credit|payment|phone|tel|call|fax|mobile|cell)", "the")
    prose = F.concat(F.regexp_replace(prose, r"[=:#+]", " "), F.lit(" "))
    goes_on = by_kind({k: after if k == "email" else pick(GOES_ON, 4) for k in KINDS})
    # columns first, so that no version computes them again
    own = own.withColumns({"_plainly": plainly, "_loosely": loosely, "_other": other, "_said": said, "_against": against, "_prose": prose, "_goes_on": goes_on})
    m, b, a = "match", "before", "after"
    rows = [(m, b, a, 1.0), ("_plainly", b, a, 1.0), ("_plainly", "_said", a, 1.0), ("_loosely", "_said", a, 1.0), ("_plainly", "_against", a, 0.0),
            ("_loosely", "_against", a, 0.0), ("_loosely", "_prose", a, None), ("_plainly", "_prose", "_goes_on", 0.0), ("_loosely", "_prose", "_goes_on", 0.0)]
    each = F.explode(F.array(*(F.struct(F.col(m).alias("m"), F.col(b).alias("b"), F.col(a).alias("a"), F.lit(x).cast("double").alias("x"),
                                        F.lit(a == "_goes_on").alias("on")) for m, b, a, x in rows)))
    rows = own.select("kind", "mark", "_other", each.alias("v")).select("kind", "mark", "_other", "v.*")
    return rows.select(
        "kind", F.when(F.col("on") & (kind == "email"), F.col("_other")).otherwise(F.col("m")).alias("match"), F.right("b", F.lit(_LEFT)).alias("before"),
        F.left("a", F.lit(_RIGHT)).alias("after"), F.coalesce("x", (kind == "card").cast("double")).alias("label"), "mark")


@dataclass
class PiiModel:
    """``held_out``: per kind the precision and recall on the fifth of the
    training rows that the trees have not seen, at the kind's threshold."""

    trees: GBTClassificationModel | None
    thresholds: dict[str, float]
    held_out: dict[str, tuple[float, float]]


def fit(spans: DataFrame, params: PiiParams = PiiParams()) -> PiiModel:
    """Boosted trees on four fifths of all training spans, with all their
    versions; all of the other fifth sets each kind's threshold: the least score bound
    at which the share of true spans reaches ``precision`` (2.0, so none, where
    no bound does)."""
    rows = with_features(training_rows(spans, params)).withColumn("held", F.pmod("mark", F.lit(5)) == 0)
    # rows with the same features are one row that weighs as many
    rows = staged(rows.groupBy("kind", "held", "label", "features").agg(F.count("*").alias("n")), "pii-train")
    learn = rows.where("not held")
    if learn.select("label").distinct().count() < 2:
        return PiiModel(None, {}, {})
    weight = F.col("n").cast("double")
    for r in learn.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # one per kind
        if r["n"] > params.even_rows:
            weight = F.when(F.col("kind") == r["kind"], F.col("n") * F.lit(params.even_rows / r["n"])).otherwise(weight)
    trees = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, stepSize=0.3, seed=params.seed, maxMemoryInMB=64,
                          weightCol="weight").fit(learn.withColumn("weight", weight))
    held = trees.transform(rows.where("held"))
    bins = held.withColumn("bin", F.floor(vector_to_array("probability")[1] * 50) / 50)
    counts = bins.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("true"), F.sum("n").alias("n")).collect()  # 4 x 51
    thresholds, held_out = {}, {}
    for kind in KINDS:
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["bin"])
        true = n = 0.0
        thresholds[kind] = 2.0
        for r in own:
            true, n = true + r["true"], n + r["n"]
            if true >= params.precision * n and r["bin"] >= 0.5:
                thresholds[kind] = r["bin"]
                held_out[kind] = (true / n, true / max(1.0, sum(x["true"] for x in own)))
    return PiiModel(trees, thresholds, held_out)


def judged_spans(spans: DataFrame, model: PiiModel) -> DataFrame:
    """``doc_id, text_hash, base, spans`` per text with any: the base spans,
    and those with the accepted others (best score first, none overlapping a
    span already there), as arrays of ``start, end, kind``."""
    key = ["doc_id", "text_hash"]
    span = F.struct("start", "end", "kind")
    base = spans.where("base").select(*key, F.lit(None).cast("double").alias("score"), span.alias("span"))
    rows = base
    if model.trees is not None:
        bound = F.lit(2.0)
        for kind, t in model.thresholds.items():
            bound = F.when(F.col("kind") == kind, F.lit(t)).otherwise(bound)
        others = model.trees.transform(with_features(spans.where("not base")))
        others = others.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= bound)
        rows = base.unionAll(others.select(*key, "score", span.alias("span")))
    of_text = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("score").isNull(), F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("rank"), "span")))).alias("others"))

    def add(acc: Column, one: Column) -> Column:
        new = one["span"]
        clash = F.exists(acc, lambda s: (s["start"] < new["end"]) & (new["start"] < s["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(new)))

    accepted = F.array_sort(F.aggregate("others", F.col("base"), add))
    return of_text.select(*key, "base", accepted.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans by kind as listed, then start, comma-joined."""
    parts = [F.transform(F.array_sort(_of_kind(spans, kind)),
                         lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
             for kind in KINDS]
    return F.array_join(F.concat(*parts), ",")


def _with_spans(docs: DataFrame, params: PiiParams) -> DataFrame:
    """``docs`` with ``_pii_base`` and ``_pii_spans`` arrays."""
    spans = staged(candidates(docs), "pii-candidates")
    found = judged_spans(spans, fit(spans, params)).select(
        F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_of"), F.col("base").alias("_pii_base"), F.col("spans").alias("_pii_spans"))
    hashed = docs.withColumn("_pii_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = hashed.join(found, F.col("_pii_id").eqNullSafe(hashed["doc_id"]) & (F.col("_pii_of") == F.col("_pii_hash")), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), _no_spans("kind")) for c in ("_pii_base", "_pii_spans")}).select(
        *[hashed[c] for c in docs.columns], "_pii_base", "_pii_spans")


def find_personal_data(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row.

    Counts and digest are of the base spans; ``spans`` lists all accepted.
    Null texts count as empty; null ids and repeated rows keep their rows, and
    equal rows have equal spans; other columns are ignored; an empty table
    gives an empty result.
    """
    rows = _with_spans(docs.select("doc_id", "text"), params)
    counts = [F.size(_of_kind(F.col("_pii_base"), kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("_pii_base")), 256).alias("base_sha256"), listed(F.col("_pii_spans")).alias("spans"))


def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each accepted span replaced by ``[KIND]``; spans that
    overlap become one, named by the first. Rows and columns stay; ``n_chars``
    follows the new text where there is such a column."""
    rows = _with_spans(docs, params)

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    rows = rows.withColumn("_pii_spans", F.aggregate(F.array_sort("_pii_spans"), _no_spans("kind"), merge))
    text, spans = F.col("text"), F.col("_pii_spans")
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    labels = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))), F.array(F.lit("")))
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e"), labels.alias("l")),
                         lambda x: F.concat(F.substring(text, x["b"] + 1, x["e"] - x["b"]), x["l"]))
    changed = {"text": F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)}
    out = rows.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_pii_spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
