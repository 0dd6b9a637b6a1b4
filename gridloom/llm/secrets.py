"""Secret scan: fixed patterns, and runs of characters that a Markov model of random strings explains better than one of identifiers.

DataFrame functions only. Behaviour in edge cases: a null text is an empty one; empty tables give empty results;
repeated rows give one result each; other columns of the input are ignored unless `carry` names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_table, table, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Code points that a run may hold: '+' to 'z'.
LOW, HIGH = ord("+"), ord("z")
SIDE = HIGH - LOW + 1
RUN = r"[A-Za-z0-9+/_-]"

#: Words of ordinary identifiers, the negative samples' parts.
WORDS = (
    "account action address agent array batch before block body buffer build cache call check child class client close code column commit "
    "config connect content context control count create current data date default delete detail device dialog document domain driver edit "
    "element email enable encode entity error event example execute export factory field file filter find folder format frame function "
    "generate get global graph group handle header height helper history home image import index info input install instance interface "
    "internal item join key label language last layout length level library limit line link list load local location lock login main "
    "manager map master match matrix member memory menu message method model module mount name network next node number object offset open "
    "option order output owner package page panel param parent parse path pattern payment pending permission player plugin point policy "
    "position post prefix previous price print private process product profile project property provider public query queue random range "
    "read record region register release remote remove render replace report request reset resource response result return role root route "
    "row rule runtime sample save scale schedule schema screen script search section select send sequence server service session set shape "
    "share signal simple size sort source stack start state static status step stop storage store stream string style submit summary "
    "support switch symbol system table target task team template test text theme thread time title tool total trace track transaction "
    "transform translate tree trigger type unit update upload user util valid value vector version view visible volume wait widget width "
    "window worker wrapper write zone the and of to in that is for with on are was this from have not they which one you were all their "
    "there been many these would other into than time only could new also after two our between through nation ation tion ing ment ness"
).split()


def samples(spark: SparkSession, n: int = 4096) -> DataFrame:
    """(s, random): n labelled strings of each class, made by rule, so that training is bounded and repeatable."""
    ids = spark.range(n)
    sha = F.sha2(F.concat(F.lit("gridloom-secret-"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(sha)), "[=\\s]", "")
    random = ids.select(F.when(F.col("id") % 4 == 0, sha).when(F.col("id") % 4 == 1, F.translate(b64, "+/", "")).when(F.col("id") % 4 == 2, F.translate(b64, "+/", "-_")).otherwise(b64).alias("s"), F.lit(True).alias("random"))
    words = F.expr("split('" + " ".join(WORDS) + "', ' ')")
    pick = [F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(WORDS))) + 1).cast("int")) for k in range(5)]
    camel = F.concat(pick[0], *[F.initcap(p) for p in pick[1:]])
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(100)).cast("string")
    plain = ids.select(
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", *pick)).when(F.col("id") % 6 == 1, camel).when(F.col("id") % 6 == 2, F.concat_ws("-", *pick)).when(F.col("id") % 6 == 3, F.concat_ws("/", *pick)).when(F.col("id") % 6 == 4, F.upper(F.concat_ws("_", *pick))).otherwise(F.concat(F.concat_ws("", *pick), number)).alias("s"),
        F.lit(False).alias("random"),
    )
    return random.unionByName(plain)


def bigrams(token: Column) -> Column:
    """Cell numbers, from 1, of the token's neighbouring characters in a SIDE x SIDE table."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW)
    n = F.size(codes)
    return F.zip_with(F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), F.slice(codes, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * SIDE + b + 1)


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(b|a, random) - log P(b|a, identifier) for each pair of characters, from rows (s, random).

    What comes to the driver is at most two counts for each of SIDE x SIDE cells, whatever the number of rows.
    """
    counts = {0: [0.0] * SIDE**2, 1: [0.0] * SIDE**2}
    rows = labelled.where(F.col("s").rlike(f"^{RUN}+$")).select("random", F.explode(bigrams(F.col("s"))).alias("cell")).groupBy("random", "cell").count()
    for r in rows.collect():
        counts[int(r["random"])][r["cell"] - 1] += r["count"]
    logs = {}
    for k, c in counts.items():
        total = [sum(c[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        logs[k] = [math.log((c[i] + smoothing) / (total[i // SIDE] + smoothing * SIDE)) for i in range(SIDE**2)]
    return [x - y for x, y in zip(logs[1], logs[0], strict=True)]


def _places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<s,k,e>> of the pattern's leftmost matches: pieces between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (keep(m) if keep else F.lit(True)).alias("ok")))
    empty = F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)")
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.when(x["ok"], F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), F.lit(kind).alias("k"), (acc["at"] + x["gap"] + x["len"]).alias("e"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return walked


def scan(docs: DataFrame, llr: list[float], *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), min_run: int = 20, min_total: float = 14.0, min_mean: float = 0.4, min_distinct: int = 8) -> DataFrame:
    """The carried columns with `base` and `found`: sorted arrays of (s start, k kind number, e end), in code points, ends exclusive.

    `found` adds to `base` the runs of at least `min_run` characters with `min_distinct` different ones, whose
    log-likelihood ratio reaches `min_total` in all and `min_mean` a character. Each pattern is gated by a cheap test, so texts without any match are passed over once.
    """
    t = text_of(text)
    empty = F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)")
    scores = number_table(llr)
    total = lambda m: F.aggregate(bigrams(m), F.lit(0.0), lambda acc, i: acc + F.element_at(scores, i.cast("int")))
    varied = lambda m: F.size(F.array_distinct(F.split(m, ""))) >= min_distinct
    unlikely = lambda m: varied(m) & (total(m) >= F.greatest(F.lit(min_total), F.length(m) * F.lit(min_mean)))
    gated = lambda gate, places: F.when(gate, places).otherwise(empty)
    src = docs.select(*carry, t.alias("_text"))
    t = F.col("_text")
    run = RUN + "{" + str(min_run) + ",}"
    out = src.select(
        *carry,
        gated(t.rlike(ASSIGN_GATE), _places(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)).alias("_a"),
        gated(t.contains("AKIA"), _places(t, ACCESS, 1)).alias("_c"),
        gated(t.rlike(HEX), _places(t, HEX, 2)).alias("_h"),
        gated(t.rlike(run), _places(t, run, 3, unlikely)).alias("_r"),
    )
    return out.select(*carry, F.array_sort(F.concat("_a", "_c", "_h")).alias("base"), F.array_sort(F.concat("_a", "_c", "_h", "_r")).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"), train(samples(spark)))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return got.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
