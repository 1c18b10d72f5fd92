"""Personal data: high-recall candidate spans, gradient boosted trees over format and context, calibrated thresholds.

Everything runs as DataFrame and SQL expressions: spans come from the pieces that a split at the pattern leaves, features
are functions of span and neighbourhood, and the trained trees are compiled into one CASE expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns of the base kinds. Possessive where no way back could match, so that Java needs no stack for long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

BASE = [("email", EMAIL, "%@%"), ("ip", IP, "%.%.%.%"), ("card", CARD, None), ("phone", PHONE, "%+%")]

# Fixed patterns of the candidates, which may overlap each other and the base spans.
CANDIDATES = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\((?i:at)\)|\[(?i:at)\]|\{(?i:at)\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\((?i:dot)\)|\[(?i:dot)\]) ?[A-Za-z]{2,24})++", "(at)"),
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ ./-][0-9][0-9 ./-]{4,14}[0-9](?![0-9A-Za-z])", None),
    ("id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "%-%"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", None),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "%:%"),
    ("secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+(?![A-Za-z0-9_/+=-])", None),
]
KINDS = [k for k, _, _ in BASE] + sorted({k for k, _, _ in CANDIDATES} - {k for k, _, _ in BASE})
CONTEXT = 32


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPANS = "array<struct<k:string,s:int,e:int,v:string,l:string>>"
#: Prefix sums go over so many matches at a time, so that a text of very many matches costs no square of their number.
STEP = 128


def spans(text: str, kind: str, pattern: str, hint: str | None) -> str:
    """SQL for array<struct<k,s,e,v,l>>: leftmost non-overlapping matches with places in code points and the text before.

    The text between matches comes from a split at the same pattern, so that no position function is needed; places are
    prefix sums of the pieces' lengths, first within steps of matches, then over the steps.
    """
    found = f"regexp_extract_all({text}, {literal(pattern)}, 0)"
    if hint == "(at)":
        found = f"CASE WHEN contains(lower({text}), '(at)') OR contains(lower({text}), '[at]') OR contains(lower({text}), '{{at}}') THEN {found} ELSE array() END"
    elif hint:
        found = f"CASE WHEN {text} LIKE '{hint}' THEN {found} ELSE array() END"
    cut = f"slice(split({text}, {literal(pattern)}, -1), 1, size(m))"
    within = f"""aggregate(slice(z, i * {STEP} + 1, {STEP}), named_struct('at', 0, 'out', cast(array() AS {SPANS})),
        (a, x) -> named_struct('at', a.at + length(x.p) + length(x.v), 'out', concat(a.out, array(named_struct('k', '{kind}', 's', a.at + length(x.p), 'e', a.at + length(x.p) + length(x.v), 'v', x.v, 'l', right(x.p, {CONTEXT}))))))"""
    over = f"""aggregate(transform(sequence(0, cast((size(z) - 1) div {STEP} AS int)), i -> {within}), named_struct('at', 0, 'out', cast(array() AS array<{SPANS}>)),
        (a, y) -> named_struct('at', a.at + y.at, 'out', concat(a.out, array(transform(y.out, x -> named_struct('k', x.k, 's', a.at + x.s, 'e', a.at + x.e, 'v', x.v, 'l', x.l))))), a -> flatten(a.out))"""
    return f"""transform(array({found}), m -> CASE WHEN size(m) = 0 THEN cast(array() AS {SPANS}) ELSE
        transform(array(zip_with({cut}, m, (p, v) -> named_struct('p', p, 'v', v))), z -> {over})[0] END)[0]"""


def before(spans: str, end: str, field: str, than: str) -> str:
    """SQL for how many of spans, in order, have the field below (or, for e, not above) than: by halving, as they are sorted."""
    sign = "<" if field == "s" else "<="
    return f"""aggregate(sequence(1, {end}), named_struct('l', 0, 'h', size({spans})), (w, i) -> CASE WHEN w.l >= w.h THEN w
        WHEN {spans}[shiftright(w.l + w.h, 1)].{field} {sign} {than} THEN named_struct('l', shiftright(w.l + w.h, 1) + 1, 'h', w.h) ELSE named_struct('l', w.l, 'h', shiftright(w.l + w.h, 1)) END, w -> w.l)"""


def overlapping(spans: str, x: str) -> str:
    """SQL for those of spans (of one kind: sorted and apart) that overlap x; together they are no more than all spans."""
    steps = f"cast(ceil(log2(size({spans}) + 1)) AS int)"
    low, high = before(spans, steps, "e", f"{x}.s"), before(spans, steps, "s", f"{x}.e")
    return f"CASE WHEN size({spans}) = 0 THEN {spans} ELSE transform(array({low}), low -> slice({spans}, low + 1, greatest(0, {high} - low)))[0] END"


LUHN = """pmod(aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substr({d}, length({d}) - i + 1, 1) AS int)
    ELSE 2 * cast(substr({d}, length({d}) - i + 1, 1) AS int) - CASE WHEN substr({d}, length({d}) - i + 1, 1) >= '5' THEN 9 ELSE 0 END END), 10)"""


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def valid(x: str) -> str:
    """SQL of the checks that a base span must pass."""
    d = f"{digits(x + '.v')}"
    card = f"CASE WHEN length({d}) BETWEEN 16 AND 19 THEN {LUHN.format(d=d)} = 0 ELSE false END"
    return f"""CASE {x}.k WHEN 'email' THEN true
        WHEN 'ip' THEN forall(split({x}.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS decimal(38,0)), 0) <= 255)
        WHEN 'phone' THEN length({d}) BETWEEN 8 AND 15
        ELSE {card} END"""


HINTS = {
    "phone": "phone|tel|call|mobile|fax|cell|contact|ring|whatsapp|appel|anruf|llama",
    "email": "mail|contact|write|reach|address",
    "secret": "pass|secret|token|key|auth|bearer|credential|pwd|login",
    "account": "iban|account|bank|ssn|social|passport|tax|security|konto",
    "thing": "version|order|invoice|part|isbn|page|date|on |price|commit|build|sha|hash|md5|serial|ticket|ratio|score|figure|chapter",
}


def features(x: str) -> list[str]:
    """SQL of a candidate's numbers: its kind, its format, and words before it."""
    v, d = f"{x}.v", digits(f"{x}.v")
    at = lambda k: f"CASE WHEN {x}.k = '{k}' THEN 1D ELSE 0D END"
    out = [at(k) for k in ("email", "phone", "id", "iban", "ip", "secret")]
    out += [f"cast(length({v}) AS double)", f"cast(length({d}) AS double)", f"cast(length(regexp_replace({v}, '[^A-Z]', '')) AS double)", f"cast(length(regexp_replace({v}, '[^a-z]', '')) AS double)", f"cast(length(regexp_replace({v}, '[A-Za-z0-9]', '')) AS double)"]
    out += [f"cast(size(array_distinct(split({v}, ''))) AS double)", f"cast(size(split({v}, '[^A-Za-z0-9]+')) AS double)", f"cast(size(split({v}, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])')) AS double)"]
    out += [f"CASE WHEN lower({v}) RLIKE '[^0-9a-f]' THEN 0D ELSE 1D END", f"CASE WHEN {v} RLIKE '^(19|20)[0-9]{{2}}[ ./-]|[ ./-](19|20)[0-9]{{2}}$' THEN 1D ELSE 0D END", f"CASE WHEN {v} RLIKE '/' THEN 1D ELSE 0D END"]
    out += [f"CASE WHEN lower({x}.l) RLIKE '{words}' THEN 1D ELSE 0D END" for words in HINTS.values()]
    return out


@lru_cache(maxsize=4)
def examples_sql(n: int, seed: int) -> str:
    """SQL for n labelled candidates (k, v, l, y), formats and contexts drawn by hash: the training rows' bound is n."""
    r = lambda tag, m: f"pmod(xxhash64({seed}, '{tag}', id), {m})"
    num = lambda tag, m: f"lpad(substr(cast(pmod(xxhash64({seed}, '{tag}', id), 1000000000000) + 1000000000000 AS string), 2), {m}, '0')"
    hexa = f"sha2(concat('{seed}', id), 256)"
    good = {"phone": "array('phone ', 'call me at ', 'Tel: ', 'mobile ', 'contact: ', 'and ', 'then the ', '')", "email": "array('mail ', 'write to ', 'contact ', 'and ', '')", "id": "array('ssn ', 'social security ', 'and ', '')", "iban": "array('IBAN ', 'bank account ', 'to ', '')", "ip": "array('from ', 'host ', '')", "secret": "array('token = ', 'password=', 'secret: ', 'api key ', 'auth ', 'and the ', '')"}
    bad = "array('version ', 'order ', 'invoice ', 'part ', 'page ', 'date ', 'price ', 'figure ', 'commit ', 'build ', 'ratio ', 'chapter ')"
    # where formats differ, wrong candidates also stand in plain running text, so that the format must tell them
    plain = bad.replace("array(", "array('and ', 'then the ', 'of ', 'with ', 'to ', '', '', '', '', '', '', '', ")
    n1, n2, n3 = num("a", 3), num("b", 4), num("c", 4)
    pos = {
        "phone": f"element_at(array(concat('(', {n1}, ') ', {num('d', 3)}, '-', {n2}), concat({n1}, '-', {num('d', 3)}, '-', {n2}), concat('0', {n1}, ' ', {n2}, {num('e', 3)}), concat({n1}, '.', {num('d', 3)}, '.', {n2})), cast({r('f', 4)} + 1 AS int))",
        "email": f"concat('user', {n1}, element_at(array(' [at] ', ' (at) ', '(at)'), cast({r('f', 3)} + 1 AS int)), 'mail', {n1}, element_at(array('.com', ' [dot] org', ' (dot) net'), cast({r('g', 3)} + 1 AS int)))",
        "id": f"concat({n1}, '-', {num('d', 2)}, '-', {n2})",
        "iban": f"concat(element_at(array('DE', 'FR', 'ES', 'GB'), cast({r('f', 4)} + 1 AS int)), {num('d', 2)}, ' ', {n2}, ' ', {n3}, ' ', {num('e', 4)}, ' ', {num('g', 4)})",
        "ip": f"array_join(transform(sequence(1, 8), j -> substr({hexa}, j * 4, 4)), ':')",
        "secret": f"element_at(array(concat('AKIA', upper(substr(translate({hexa}, 'abcdef', 'GXKTWZ'), 1, 16))), substr({hexa}, 1, 40), substr(base64(unhex({hexa})), 1, 32), substr({hexa}, 1, 24), concat('password=', substr({hexa}, 1, 18))), cast({r('f', 5)} + 1 AS int))",
    }
    neg = {
        "phone": f"element_at(array(concat('20', {num('d', 2)}, '-0', {r('h', 9)} + 1, '-', {num('e', 2)}), concat({num('d', 2)}, '/', {num('e', 2)}, '/20', {num('g', 2)}), concat({n1}, '.', {num('e', 1)}, '.', {num('g', 1)}, '.0'), concat({num('d', 2)}, ' ', {num('e', 3)}, ' ', {num('g', 3)}), concat('978-', {num('e', 1)}, '-', {num('g', 5)})), cast({r('f', 5)} + 1 AS int))",
        "email": "'look (at) this.one'",
        "id": f"concat({n1}, '-', {num('d', 2)}, '-', {n2})",
        "iban": f"concat('AB', {num('d', 2)}, ' SERI ALNU MBER')",
        "ip": "array_join(transform(sequence(1, 6), j -> lpad(cast(pmod(j * 7 + id, 60) AS string), 2, '0')), ':')",
        "secret": f"element_at(array(repeat('=', 24), repeat('-', 40), concat('/usr/lib/', repeat('path', 4)), 'antidisestablishmentarian', concat('self-explanatory-', 'long-word'), concat('thanbleshaning', 'tionntthere'), 'UNIVERSITYENTRANCEEXAM', concat(repeat('word_', 3), 'name'), concat('section-', {num('e', 2)}, '-introduction')), cast({r('f', 9)} + 1 AS int))",
    }
    pick = lambda a, tag: f"element_at({a}, cast(pmod(xxhash64({seed}, '{tag}', id), size({a})) + 1 AS int))"
    case = lambda of: "CASE k " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"
    before = case({k: f"CASE WHEN y = 1 THEN {pick(good[k], 'l')} ELSE {pick(bad if k == "id" else plain, 'l')} END" for k in pos})
    kinds = ", ".join(f"'{k}'" for k in pos)
    return f"""SELECT id, k, y, {before} AS l, CASE WHEN y = 1 THEN {case(pos)} ELSE {case(neg)} END AS v FROM (
        SELECT id, element_at(array({kinds}), cast({r('k', len(pos))} + 1 AS int)) AS k, {r('y', 2)} AS y FROM range({n}))"""


class Trees:
    """Boosted trees as SQL over an array f of features, with a threshold of each kind."""

    def __init__(self, weights: list[float], texts: list[str], thresholds: dict[str, float]):
        self.weights, self.texts, self.thresholds = weights, texts, thresholds

    @staticmethod
    def sql(text: str) -> str:
        """A tree's printed form as nested CASE expressions."""
        lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]

        def node(i: int) -> tuple[str, int]:
            if m := re.match(r"Predict: (\S+)", lines[i]):
                return f"{float(m[1])!r}D".replace("e", "E"), i + 1
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
            yes, j = node(i + 1)
            no, j = node(j + 1)
            return f"CASE WHEN f[{m[1]}] <= {float(m[2])!r}D THEN {yes} ELSE {no} END".replace("e-", "E-"), j

        return node(0)[0]

    def score(self) -> str:
        margin = " + ".join(f"{w!r}D * ({self.sql(t)})" for w, t in zip(self.weights, self.texts))
        return f"1D / (1D + exp(-2D * ({margin})))"

    def accepted(self, kind: str, score: str) -> str:
        return f"{score} >= CASE {kind} " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in sorted(self.thresholds.items())) + " ELSE 2D END"


_fitted: dict[tuple, Trees] = {}


def train(spark: SparkSession, examples: int = 6000, rounds: int = 12, depth: int = 4, precision: float = 0.95, prior: float = 20.0, seed: int = 7) -> Trees:
    """Fits the trees on three quarters of examples labelled candidates and calibrates each kind's threshold on the rest.

    A threshold is the lowest score (in hundredths) from which on the held-out precision is at least precision, where each
    wrong candidate counts prior times, as a corpus has about so many for a right one while the examples have one. The
    examples come from formats and contexts, not from the corpus, so the model is the same for every corpus.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    if (known := (examples, rounds, depth, precision, prior, seed)) in _fitted:
        return _fitted[known]
    d = spark.sql(examples_sql(examples, seed)).select("id", "k", F.col("y").cast("double").alias("label"), F.struct("k", "v", "l").alias("x"))
    d = d.select("id", "k", "label", F.array(*[F.expr(e) for e in features("x")]).alias("f")).coalesce(1).cache()
    fit = d.where("id % 4 <> 0").select("label", array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, maxBins=16).fit(fit)
    texts = [t._java_obj.toDebugString() if hasattr(t, "_java_obj") else t.toDebugString for t in model.trees]
    trees = Trees([float(w) for w in model.treeWeights], texts, {})
    scored = d.where("id % 4 = 0").selectExpr("k", "label", f"cast(floor(100 * ({trees.score()})) AS int) AS s").groupBy("k", "s").agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()  # at most 101 rows a kind
    d.unpersist()
    for kind in {r.k for r in scored}:
        good = of = 0
        for r in sorted((r for r in scored if r.k == kind), key=lambda r: -r.s):
            good, of = good + r.good, of + r.good + prior * (r.all - r.good)
            if good / of >= precision:
                trees.thresholds[kind] = r.s / 100
    _fitted[known] = trees
    return trees


def find(docs: DataFrame, text: str = "text", trees: Trees | None = None, base: str = "pii_base", every: str = "pii_spans") -> DataFrame:
    """docs with two columns of array<struct<kind,start,end>> (code points, end exclusive), each in order of kind and start.

    base has the fixed kinds email, ip, card and phone, leftmost and non-overlapping per kind; matches that fail their
    check are dropped without another try. every has these and the candidates that the trees accept at their kind's
    threshold, but for candidates that overlap a base span or an accepted candidate of a higher score (of equal ones, the
    earlier and longer stays). Null and empty texts have no spans; rows are judged alone; columns of docs of these names
    are replaced, all others stay.
    """
    trees = trees or train(docs.sparkSession)
    given = [f"_in{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*given).withColumn("_t", F.coalesce(F.col(given[docs.columns.index(text)]), F.lit("")))
    kinds = [k for k, _, _ in CANDIDATES]
    d = d.withColumns({f"_b_{k[0]}": F.expr(f"filter({spans('_t', *k)}, x -> {valid('x')})") for k in BASE} | {f"_g_{k[0]}": F.expr(spans("_t", *k)) for k in CANDIDATES})
    # candidates apart from the base spans, with the trees' score; then those at or over their kind's threshold
    alone = lambda k: f"filter(_g_{k}, c -> " + " AND ".join(f"size({overlapping(f'_b_{b}', 'c')}) = 0" for b, _, _ in BASE) + ")"
    d = d.withColumn("_a", F.expr(f"concat({', '.join(map(alone, kinds))})"))
    d = d.withColumn("_s", F.expr(f"transform(transform(_a, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'f', array({', '.join(features('x'))}))), y -> named_struct('k', y.k, 's', y.s, 'e', y.e, 'p', transform(array(y.f), f -> {trees.score()})[0]))"))
    d = d.withColumns({f"_c_{k}": F.expr(f"filter(_s, c -> c.k = '{k}' AND {trees.accepted('c.k', 'c.p')})") for k in kinds})
    better = "(o.p > c.p OR o.p = c.p AND (o.s < c.s OR o.s = c.s AND (o.e > c.e OR o.e = c.e AND o.k < c.k)))"
    own = lambda k: f"filter(_c_{k}, c -> " + " AND ".join(f"NOT exists({overlapping(f'_c_{o}', 'c')}, o -> {better})" for o in kinds if o != k) + ")"
    part = lambda x: f"transform({x}, x -> named_struct('kind', x.k, 'start', x.s, 'end', x.e))"
    of_base, of_more = {k: f"_b_{k}" for k, _, _ in BASE}, {k: own(k) for k in kinds}
    order = "(x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 WHEN x.end < y.end THEN -1 WHEN x.end > y.end THEN 1 ELSE 0 END"
    both = lambda k: f"array_sort(concat({', '.join(part(of[k]) for of in (of_base, of_more) if k in of)}), {order})"
    d = d.withColumns({"_base": F.expr(f"concat({', '.join(part(of_base[k]) for k, _, _ in BASE)})"), "_all": F.expr(f"concat({', '.join(map(both, KINDS))})")})
    kept = [F.col(g).alias(c) for g, c in zip(given, docs.columns) if c not in (base, every)]
    return d.select(*kept, F.col("_base").alias(base), F.col("_all").alias(every))


def digest(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """docs with every found span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    d = find(docs, text, trees, "_base", "_all")
    d = d.withColumn("_all", F.expr("""aggregate(array_sort(transform(_all, x -> named_struct('s', x.start, 'e', x.end, 'k', x.kind))), cast(array() AS array<struct<s:int,e:int,k:string>>),
        (a, x) -> CASE WHEN size(a) > 0 AND x.s < element_at(a, -1).e
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e), 'k', element_at(a, -1).k)))
            ELSE concat(a, array(x)) END)"""))
    done = F.expr(f"""aggregate(_all, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.e, 'out', concat(a.out, substr(`{text}`, a.at + 1, x.s - a.at), '[', upper(x.k), ']')), a -> concat(a.out, substr(`{text}`, a.at + 1)))""")
    return d.withColumn(text, F.when(F.size("_all") > 0, done).otherwise(F.col(text))).drop("_base", "_all").select(*docs.columns)
