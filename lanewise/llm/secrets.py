"""Secret scans: three patterns, and Markov models of random strings and ordinary identifiers.

DataFrame functions only.  The models are character bigram models over one alphabet; the random one learns from strings
that are labelled random because they are made from hashes, the ordinary one from identifiers made of the words of a
bounded sample of documents.  A long token is a secret if the log-likelihood ratio speaks clearly for random; in other
long tokens, such as paths, the runs for which it does are.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import free_prefix, quoted

#: Kinds, patterns and least lengths, in the order in which they are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
#: Nats for random over ordinary that a token needs, in all and on average for each pair of characters.
MIN_RATIO, MIN_MEAN_RATIO = 15.0, 0.7
#: Nats by which a run may fall below its best before it ends, and characters that one needs.
MAX_DROP, MIN_RUN = 8.0, 16
#: Matches gathered at a time.
BLOCK = 256
#: Labelled strings of each random form, and documents whose words make up ordinary identifiers (about).
RANDOM_STRINGS, TRAIN_DOCUMENTS = 2000, 2000


def _at(chars: Column) -> Column:
    """Place of each character in the alphabet, 0 for none."""
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(token: Column) -> Column:
    """Codes of a token's neighbouring characters: first * (size + 1) + second."""
    places = _at(F.split(token, ""))
    n = F.length(token)
    return F.zip_with(
        F.slice(places, F.lit(1), n - 1), F.slice(places, F.lit(2), n - 1), lambda a, b: a * (len(ALPHABET) + 1) + b
    )


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """token: n hashes each as hexadecimal, base 64, and capital letters with digits."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    capitals = F.upper(F.regexp_replace(F.base64(F.unhex(digest("k"))), "[+/=]", ""))
    forms = F.array(F.substring(digest("h"), 1, 40), F.base64(F.unhex(digest("b"))), F.concat(F.lit("AKIA"), F.substring(capitals, 1, 16)), F.substring(F.translate(F.base64(F.unhex(digest("u"))), "+/=", "-_"), 1, 32))
    return spark.range(n).select(F.explode(forms).alias("token"))


def ordinary_parts(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(token, weight): what identifiers made of the words of about `most` documents consist of.

    Such identifiers are words alone and neighbours joined by _, - and /, with capitals inside, in capitals, and with small
    numbers.  Each distinct word is counted once with its weight, and so are the joints between two words, which depend on
    the letters there alone; so the counts of pairs are those of all the identifiers, which are never built.
    """
    total = docs.count()
    share = min(1.0, most / total) if total else 0.0
    key = "doc_id" if "doc_id" in docs.columns else "text"
    picked = docs.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(key, "text")
    picked = picked.groupBy(key).agg(F.min("text").alias("text")) if key == "doc_id" else picked.distinct()
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), lambda w: F.length(w).between(2, 24))
    lists = picked.select(words.alias("w")).where(F.size("w") > 2)
    sides = F.transform("w", lambda x, i: F.struct(x.alias("x"), (i < F.size("w") - 1).cast("long").alias("a"), (i > 0).cast("long").alias("b")))
    single = lists.select(F.explode(sides).alias("s")).groupBy("s.x").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    form = lambda token, weight: F.struct(token.alias("token"), weight.alias("weight"))
    inner = [
        form(F.lower(x), 3 * a + 2 * b), form(x, 2 * a + 2 * b), form(F.upper(x), a + b), form(F.initcap(x), b),
        form(F.concat(F.lit("_"), F.pmod(F.hash(x), F.lit(100)).cast("string")), a),
    ]
    joints = F.zip_with(
        F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"),
        lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1)), F.right(b, F.lit(1))),
    )
    met = lists.select(F.explode(joints).alias("j")).groupBy("j").agg(F.count("*").alias("n"))
    end, start, last, n = F.substring("j", 1, 1), F.substring("j", 2, 1), F.substring("j", 3, 1), F.col("n")
    both = lambda p, q: form(F.concat(p, q), n)
    outer = [both(F.lower(end), F.upper(start)), both(F.lower(last), F.lit("_"))]
    for mark, case in (("_", F.lower), ("_", F.upper), ("-", F.concat), ("/", F.concat)):
        outer += [both(case(end), F.lit(mark)), both(F.lit(mark), case(start))]
    parts = single.select(F.explode(F.array(*inner)).alias("p")).unionByName(met.select(F.explode(F.array(*outer)).alias("p")))
    return parts.select("p.token", "p.weight").where("weight > 0")


def train(docs: DataFrame) -> str:
    """The table of log-likelihood ratios by pair code, as JSON; its size is fixed by the alphabet.

    docs needs text, and doc_id to sample by, else whole texts are; a null text counts as empty.  Without documents no
    token is told to be random.
    """
    spark, size = docs.sparkSession, len(ALPHABET) + 1
    labelled = random_strings(spark).select("token", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("random")).unionByName(
        ordinary_parts(docs).withColumn("random", F.lit(False))
    )
    pairs = labelled.where(F.length("token") > 1).select("random", "weight", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.sum("weight").alias("n")).collect()}
    first = {}
    for (label, pair), n in counts.items():
        first[label, pair // size] = first.get((label, pair // size), 0) + n
    smooth = 0.5
    chance = lambda label, pair: (counts.get((label, pair), 0) + smooth) / (first.get((label, pair // size), 0) + smooth * size)
    if not any(not label for label, _ in counts):
        return json.dumps([0.0] * (size * size))
    return json.dumps([round(log(chance(True, p) / chance(False, p)), 4) for p in range(size * size)])


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches that don't overlap, as structs of start, end (code points) and size of the group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.length(s))
    steps = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(whole)), lambda s: F.length(s)).alias("gap"),
        F.transform(whole, lambda s: F.length(s)).alias("size"),
        value.alias("value"),
        whole.alias("token"),
    )
    kind = "array<struct<start:int,end:int,value:int,token:string>>"
    none, nothing = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def step(acc: Column, s: Column) -> Column:
        start, full = acc["at"] + s["gap"], F.size(acc["block"]) >= BLOCK
        match = F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["value"].alias("value"), s["token"].alias("token"))
        return F.struct(
            (start + s["size"]).alias("at"),
            F.when(full, F.array(match)).otherwise(F.array_append(acc["block"], match)).alias("block"),
            F.when(full, F.array_append(acc["blocks"], acc["block"])).otherwise(acc["blocks"]).alias("blocks"),
        )

    # Appending copies, so matches are gathered in blocks.
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("block"), nothing.alias("blocks")),
        step,
        lambda acc: F.flatten(F.array_append(acc["blocks"], acc["block"])),
    )


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")


def _base(text: Column, kind: int) -> tuple[str, int, int, Column]:
    """Pattern, group and least length of a kind, and whether a text can hold it."""
    return (
        (ASSIGN, 2, MIN_VALUE, text.rlike(ASSIGN)),
        (ACCESS, 0, MIN_ACCESS, text.contains("AKIA")),
        # A run of 24 or more is found whole either way.
        ("[0-9a-f]{%d,}" % MIN_HEX, 0, MIN_HEX, text.rlike("[0-9a-f]{%d}" % MIN_HEX)),
    )[kind]


def _spans(text: Column, kind: int) -> Column:
    """Sorted structs (start, kind, end) of a kind; texts without a possible match skip the walk."""
    pattern, group, least, possible = _base(text, kind)
    found = F.filter(_matches(text, pattern, group), lambda s: s["value"] >= least)
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(possible, spans).otherwise(_none())


def _blanked(text: Column, kind: int) -> Column:
    """text with spaces in place of the spans of a kind; all places stay."""
    pattern, group, least, _ = _base(text, kind)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    filled = F.zip_with(whole, value, lambda w, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(w))).otherwise(w))
    return F.array_join(F.zip_with(gaps, filled, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _runs(s: Column, table: Column) -> Column:
    """Structs (start, kind, end) of the random runs of a token s: pieces whose ratios, less the mean that a secret needs,
    sum highest; each is widened to the separators around it."""
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    double = sorted(ALPHABET.index(c) * (len(ALPHABET) + 1) + ALPHABET.index(c) + len(ALPHABET) + 2 for c in "+/_=-")
    scores = F.transform(_pairs(s["token"]), lambda p: F.when(p.isin(double), F.lit(-1e9)).otherwise(F.get(table, p) - MIN_MEAN_RATIO))

    def step(acc: Column, r: Column) -> Column:
        on = acc["sum"] + r
        ends = (on <= 0) | (on < acc["best"] - MAX_DROP)
        fit = acc["best"] + MIN_MEAN_RATIO * (acc["to"] - acc["from"] - 1) >= MIN_RATIO
        run = F.struct(acc["from"].alias("a"), acc["to"].alias("b"))
        return F.struct(
            (acc["k"] + 1).alias("k"),
            F.when(ends, 0.0).otherwise(on).alias("sum"),
            F.when(ends, acc["k"] + 1).otherwise(acc["from"]).alias("from"),
            F.when(ends, 0.0).otherwise(F.greatest(acc["best"], on)).alias("best"),
            F.when(ends, acc["k"] + 1).when(on > acc["best"], acc["k"] + 2).otherwise(acc["to"]).alias("to"),
            F.when(ends & fit, F.array_append(acc["found"], run)).otherwise(acc["found"]).alias("found"),
        )

    zero = F.struct(
        F.lit(0).alias("k"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("to"),
        none.alias("found"),
    )
    found = F.aggregate(F.concat(scores, F.array(F.lit(-1e9))), zero, step)["found"]

    def widened(r: Column) -> Column:
        left = F.length(F.regexp_extract(F.substring(s["token"], F.lit(1), r["a"]), "[A-Za-z0-9]*$", 0))
        right = F.length(F.regexp_extract(F.substring(s["token"], r["b"] + 1, F.length(s["token"])), "^[A-Za-z0-9]*", 0))
        return F.struct((s["start"] + r["a"] - left).alias("start"), F.lit(3).alias("kind"), (s["start"] + r["b"] + right).alias("end"))

    letter = lambda r: F.substring(s["token"], r["start"] - s["start"] + 1, r["end"] - r["start"]).rlike("[A-Za-z]")
    return F.array_distinct(F.filter(F.transform(found, widened), lambda r: (r["end"] - r["start"] >= MIN_RUN) & letter(r)))


def _scanned(docs: DataFrame, ratios: str, p: str) -> DataFrame:
    """docs with the columns <p>0 to <p>2 (spans of each pattern), <p>base and <p>all."""
    text, table = F.col(f"{p}text"), F.from_json(F.lit(ratios), "array<double>")
    found = docs.withColumn(f"{p}text", F.coalesce("text", F.lit("")))
    found = found.withColumns({f"{p}{k}": _spans(text, k) for k in range(3)})
    found = found.withColumn(f"{p}base", F.array_sort(F.concat(*[f"{p}{k}" for k in range(3)])))
    # Tokens are looked for in what the patterns leave.
    rest = text
    for k in range(3):
        rest = F.when(F.size(f"{p}{k}") > 0, _blanked(rest, k)).otherwise(rest)
    found = found.withColumn(f"{p}rest", F.when(F.size(f"{p}base") > 0, rest).otherwise(text))
    rest = F.col(f"{p}rest")
    tokens = F.filter(F.when(rest.rlike(TOKEN), _matches(rest, TOKEN)), lambda s: s["token"].rlike("[A-Za-z]"))
    found = found.withColumn(f"{p}tokens", tokens)
    ratio = lambda t: F.aggregate(_pairs(t), F.lit(0.0), lambda acc, p: acc + F.get(table, p))
    random = lambda s: s["token"].rlike("[0-9]") & (ratio(s["token"]) >= F.greatest(F.lit(MIN_RATIO), MIN_MEAN_RATIO * (s["value"] - 1)))
    whole = lambda s: F.array(F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    learned = F.flatten(F.transform(f"{p}tokens", lambda s: F.when(random(s), whole(s)).otherwise(_runs(s, table))))
    return found.withColumn(f"{p}all", F.array_sort(F.concat(f"{p}base", F.coalesce(learned, _none()))))


RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans")


def scan(docs: DataFrame, ratios: str) -> DataFrame:
    """All columns of docs, and n_assign, n_access, n_hex, base_sha256, spans, and secret_spans (the same as structs).

    Columns of docs that bear one of these names are replaced, all others stay.  A null text counts as empty and has no
    span.  Equal texts have equal results, wherever they stand.  Tokens are scored without what a pattern found in them.
    """
    p = free_prefix(docs, "scan_")
    found = _scanned(docs, ratios, p)
    return found.select(
        *[F.col(quoted(c)) for c in docs.columns if c.lower() not in RESULTS],
        *[F.size(f"{p}{k}").cast("long").alias(RESULTS[k]) for k in range(3)],
        F.sha2(_joined(F.col(f"{p}base")), 256).alias("base_sha256"),
        _joined(F.col(f"{p}all")).alias("spans"),
        F.col(f"{p}all").alias("secret_spans"),
    )


def redact(docs: DataFrame, ratios: str, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret, or each run of secrets that overlap, replaced by a mark; n_chars follows where it exists.

    All columns of docs stay, whatever their names.  Texts without a secret stay as they are, null ones too.
    """
    p = free_prefix(docs, "scan_")
    found, spans, walk = _scanned(docs, ratios, p), F.col(f"{p}all"), F.col(f"{p}walk")
    none, nothing = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<array<string>>)")

    def step(acc: Column, s: Column) -> Column:
        first, full = s["start"] >= acc["at"], F.size(acc["block"]) >= BLOCK
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            (acc["n"] + F.when(first, s["start"] - acc["at"] + len(mark)).otherwise(0)).alias("n"),
            F.when(~first, acc["block"]).when(full, F.array(piece)).otherwise(F.array_append(acc["block"], piece)).alias("block"),
            F.when(first & full, F.array_append(acc["blocks"], acc["block"])).otherwise(acc["blocks"]).alias("blocks"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), none.alias("block"), nothing.alias("blocks"))
    walked = F.aggregate(spans, start, step, lambda acc: F.struct(acc["at"].alias("at"), acc["n"].alias("n"), F.array_join(F.flatten(F.array_append(acc["blocks"], acc["block"])), "").alias("out")))
    found = found.withColumn(f"{p}walk", F.when(F.size(spans) > 0, walked))
    rest = F.substring(F.col("text"), walk["at"] + 1, F.length("text"))
    out = {"text": F.when(walk.isNull(), F.col("text")).otherwise(F.concat(walk["out"], rest))}
    if "n_chars" in docs.columns:
        # Counted from the spans: what they cover goes, a mark for each run of them comes.
        count = walk["n"] + F.length("text") - walk["at"]
        out["n_chars"] = F.when(walk.isNull(), F.col("n_chars")).otherwise(count.cast("long"))
    return found.select(*[out[c].alias(c) if c in out else F.col(quoted(c)) for c in docs.columns])
