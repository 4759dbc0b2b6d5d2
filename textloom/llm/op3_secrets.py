"""Secret scanning with a random forest that removes false positives, in DataFrame operations only.

Candidates are long runs of token characters with a digit, values assigned to a secret's name, and
private key headers. Their features are length, character transitions and shares, coverage by a
dictionary (words that the corpus itself uses often), and the path and neighbouring words, each by
the log odds that its words have among labelled findings. A random forest is fitted to at most
TRAIN_FINDINGS labelled findings and keeps the candidates it takes for secrets.

Labels come with the findings and never from the features. A caller gives findings that people have
judged; without them, `example_findings` makes some of known kinds, whose label is what they were
made as: random keys and passwords against checksums, numbers, paths, identifiers and placeholders.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

TRAIN_FINDINGS = 4000
TREES, DEPTH, SEED = 32, 8, 7
COMMON = 20  # occurrences that make a word part of the dictionary
EXAMPLES = 2_400  # findings that are made where none are given
WORDS = 512  # words before, after and in paths whose odds are learned, at most
BEFORE, AFTER = 3, 2  # neighbouring words

#: Names of secrets and token formats in public documentation.
NAMES = "token|secret|passwd|password|pwd|api_key|apikey|api-key|access_key|auth|credential|credentials|bearer|private_key"
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|sk-[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"

RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
NAMED = rf"(?i:{NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?"  # a name may have any prefix
SIGN = r"[:=]\s{0,2}[\"']?"  # what a name ends with
VALUE = r"[^\s\"']{8,}"
ASSIGNED = rf"(?<={SIGN})(?<={NAMED}){VALUE}"  # looking behind for the sign alone is cheap
HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
CANDIDATE = f"{RUN}|{ASSIGNED}|{HEADER}"
NEAR = 64  # characters of the line before and after a candidate

FEATURES = (
    "length", "transitions", "digits", "uppers", "hex", "vowels", "distinct", "repeats", "coverage", "known_format",
    "assigned", "quoted", "address", "path_odds", "before_odds", "after_odds",
)
NEIGHBOURS = ("path", "before", "after")


def likely(text: Column) -> Column:
    """Whether a text has a candidate, told without looking behind at every character, nor for names where no sign stands."""
    assigned = text.rlike(SIGN + VALUE) & text.rlike(NAMED + VALUE)
    return text.rlike(RUN) | assigned | text.rlike(HEADER)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, ordinal, path, before, value, after."""
    text = F.col(text_col)
    rows = docs.where(likely(text)).select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), text.alias("text"))
    # what lies between the candidates is their neighbourhood: both scans are linear in the text,
    # and bound to a lambda variable they run once a row
    scanned = F.array(F.struct(F.split("text", CANDIDATE).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values")))

    def zipped(s: Column) -> Column:
        n = F.size(s["values"])
        before = F.transform(F.slice(s["gaps"], 1, n), lambda x: F.regexp_extract(F.right(x, F.lit(NEAR)), r"([^\n]*)$", 1))
        after = F.transform(F.slice(s["gaps"], 2, n), lambda x: F.regexp_extract(F.left(x, F.lit(NEAR)), r"^([^\n]*)", 1))
        return F.arrays_zip(before.alias("before"), s["values"].alias("value"), after.alias("after"))

    found = F.posexplode(F.flatten(F.transform(scanned, zipped))).alias("ordinal", "f")
    return rows.select("doc_id", "path", found).select("doc_id", "ordinal", "path", "f.before", "f.value", "f.after")


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """Words of three letters or more that occur often, counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    return words.groupBy("word").count().where(F.col("count") >= COMMON).select("word")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def neighbours(side: str) -> Column:
    """The words of a path, or those next to a candidate."""
    text = F.coalesce(F.col(side), F.lit(""))
    every = F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+"), lambda w: w != "")
    if side == "path":
        return F.array_distinct(every)
    n = F.size(every)
    return F.array_distinct(F.slice(every, F.greatest(F.lit(1), n - BEFORE + 1), F.lit(BEFORE)) if side == "before" else F.slice(every, F.lit(1), F.lit(AFTER)))


def odds_of(train: DataFrame) -> dict[str, dict[str, float]]:
    """By neighbour, the log odds of the WORDS most frequent words among findings (path, before, after, label)."""
    named = lambda side: F.transform(neighbours(side), lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))
    each = F.explode(F.array(*map(named, NEIGHBOURS)))
    found = train.select("label", each.alias("words")).select("label", F.explode("words").alias("w")).select("label", "w.side", "w.word")
    counts = found.groupBy("side", "word").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    rank = Window.partitionBy("side").orderBy(F.desc("n"), "word")
    rows = counts.where("n >= 3").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= WORDS).collect()
    out: dict[str, dict[str, float]] = {s: {} for s in NEIGHBOURS}
    for r in rows:
        out[r.side][r.word] = log((r.bad + 1) / (r.n - r.bad + 1))
    return out


def features(found: DataFrame, words: DataFrame, odds: dict[str, dict[str, float]], scratch: Scratch) -> DataFrame:
    """The candidates with their features."""
    runs = F.split(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")
    values = found.select("value").distinct()
    parts = values.select("value", F.explode(runs).alias("part")).where(F.length("part") >= 3).select("value", F.lower("part").alias("word"))
    parts = scratch.write(parts, "parts")
    covered = parts.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    covered = scratch.write(covered, "covered")
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    rows = found.join(covered, "value", "left")

    def weight(side: str) -> Column:
        if not odds[side]:
            return F.lit(0.0)
        table = F.map_from_arrays(F.array(*map(F.lit, odds[side])), F.array(*map(F.lit, odds[side].values())))
        return F.aggregate(neighbours(side), F.lit(0.0), lambda total, w: total + F.coalesce(F.element_at(table, w), F.lit(0.0)))

    columns = {
        "length": F.length(value).cast("double"),
        "transitions": _share(value, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "hex": _share(value, "[0-9a-fA-F]"),
        "vowels": _share(value, "[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        "repeats": _share(value, r"(.)\1\1"),
        "coverage": F.coalesce("covered", F.lit(0)) / F.greatest(F.length(value), F.lit(1)),
        "known_format": value.rlike(FORMATS).cast("double"),
        "assigned": before.rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "address": (before.rlike(r"(?:https?://|www\.|@)\S*$") | value.rlike("/.*/")).cast("double"),
    }
    return rows.withColumns(columns | {f"{s}_odds": weight(s) for s in NEIGHBOURS}).drop("covered")


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """before, value, after, path, label: findings of known kinds, from hashes of their numbers."""
    random = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    hexes = lambda k: F.substring(random("hex"), 1, k)
    letters = lambda k: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(random("a"), random("b")))), "[+/=]", "7"), 1, k)
    digits = lambda k: F.substring(F.regexp_replace(F.concat(random("a"), random("b"), random("c")), "[a-f]", ""), 1, k)
    upper = F.translate(F.upper(F.substring(random("hex"), 1, 16)), "ABCDEF", "QWERTZ")
    word = lambda k: pick(f"w{k}", ["station", "morning", "letter", "garden", "market", "window", "river", "system", "number", "school", "winter", "paper", "engine", "travel", "summer"])
    name = pick("name", ["token", "api_key", "SECRET", "client_secret", "access_key", "auth", "AUTH_TOKEN", "apikey", "private_key"])
    pwd = pick("pwd", ["password", "DB_PASSWORD", "passwd", "pwd", "userPassword"])
    prose = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    sign = pick("sign", [" = ", "=", ": "])
    quote = pick("quote", ['"', "'", ""])
    made = (  # label, what stands before, the value, what stands after
        (1, F.concat(prose, name, F.lit(' = "')), hexes(40), F.concat(F.lit('" '), word(3))),
        (1, F.concat(name, sign, quote), pick("long", [20, 32, 40]).cast("string"), quote),
        (1, F.concat(prose, pwd, sign, quote), letters(14), F.concat(quote, F.lit(" "), word(3))),
        (1, F.concat(prose, pwd, sign), hexes(18), F.concat(F.lit(" "), word(3))),
        (1, prose, F.concat(F.lit("AKIA"), upper), F.concat(F.lit(" "), word(3))),
        (1, F.concat(prose, F.lit("key ")), F.concat(pick("start", ["ghp_", "sk-", "glpat-", "sk_live_"]), letters(36)), F.concat(F.lit(" "), word(3))),
        (1, F.lit(""), pick("header", ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"]), F.lit("")),
        (1, F.concat(pick("bear", ["Authorization: Bearer ", "bearer: ", "auth: "])), letters(32), F.lit("")),
        (0, F.concat(pick("commit", ["commit ", "revision: ", "merge ", "sha1 = \"", "checksum: "])), hexes(40), F.concat(F.lit(" "), word(3))),
        (0, F.concat(prose, pick("sum", ["sha256 ", "digest: ", "etag = \""])), random("hex"), F.lit("")),
        (0, prose, digits(16), F.concat(F.lit(" "), word(3))),
        (0, F.concat(prose, pick("card", ["card ", "phone: ", "order ", "isbn "])), digits(18), F.concat(F.lit(" "), word(3))),
        (0, F.concat(prose, pick("at", ["https://www.", "http://docs.", "see www."])), F.concat(word(4), F.lit("/"), word(5), F.lit("/2024/"), word(6)), F.lit("/")),
        (0, F.concat(pwd, sign, quote), F.concat(pick("fake", ["example-", "changeme-", "your-", "dummy_", "placeholder-", "sample-"]), word(4), F.lit("-1")), quote),
        (0, F.concat(name, sign, quote), F.concat(pick("your", ["your-token-", "insert_token_here_", "xxxxxxxxxxxxxxxx", "example-token-", "0000000000000000"]), F.substring(digits(9), 1, 1)), quote),
        (0, F.concat(pick("id", ["id: ", "uuid = \"", "request ", "session "])), F.concat_ws("-", hexes(8), F.substring(random("b"), 1, 4), F.substring(random("c"), 1, 4), F.substring(random("d"), 1, 4), F.substring(random("e"), 1, 12)), F.lit("")),
        (0, prose, F.concat(word(4), F.lit("-"), word(5), F.lit("-release-"), F.substring(digits(9), 1, 2)), F.concat(F.lit(" "), word(3))),
        (0, prose, F.concat(F.initcap(word(4)), F.initcap(word(5)), F.initcap(word(6)), F.substring(digits(9), 1, 2)), F.lit("(")),
        (0, F.concat(name, F.lit(" = ")), F.concat(pick("call", ["get_token", "read_secret", "config.auth", "os.environ.token", "self.password"]), F.lit("_"), word(4), F.lit("()")), F.lit("")),
    )
    kind = F.pmod(F.col("id"), F.lit(len(made)))
    path = F.when(F.xxhash64(F.lit("p"), "id") % 3 == 0, pick("odd", ["tests/fixtures/data.py", "docs/example.md", "sample/readme.txt"])).otherwise(pick("path", ["src/main.py", "config/app.yaml", "deploy/settings.env", "lib/client.js"]))
    row = F.lit(None).cast("struct<label:int,before:string,value:string,after:string>")
    for k, (label, before, value, after) in enumerate(made):
        value = F.when(value == "20", letters(20)).when(value == "32", letters(32)).when(value == "40", hexes(40)) if k == 1 else value
        row = F.when(kind == k, F.struct(F.lit(label).alias("label"), before.alias("before"), value.alias("value"), after.alias("after"))).otherwise(row)
    return spark.range(n).select(row.alias("r"), path.alias("path")).select("r.before", "r.value", "r.after", "path", "r.label")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None, train_findings: int = TRAIN_FINDINGS) -> DataFrame:
    """One row per candidate: doc_id, ordinal (in the text), value, score, is_secret.

    findings: labelled candidates (before, value, after, path, label 1 or 0) to learn from, those of
    `example_findings` if none are given. If all labels are equal every candidate gets that label,
    and of an empty table the verdict is 0. Null and empty texts have no candidates; a null path has
    no words. Rows that repeat are reported as often as they occur. Texts of any length are read
    whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch, own = Scratch(spark, "secrets"), Scratch(spark, "findings")
    # a finding that is repeated counts once; which ones are taken depends on their hash alone
    sides = ("before", "value", "after", "path")
    labelled = (example_findings(spark) if findings is None else findings).select(*sides, F.col("label").cast("double").alias("label")).where("value is not null and label is not null").distinct()
    labelled = own.write(labelled.orderBy(F.xxhash64(*sides), "label").limit(train_findings), "labelled")
    odds = odds_of(labelled)
    words = scratch.write(dictionary(docs, text_col), "words")
    found = scratch.write(candidates(docs, id_col, text_col, path_col), "found")
    rows = scratch.write(features(found, words, odds, scratch), "features")
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "after")]
    train = own.write(features(labelled.select("value", "path", "label", *blank), words, odds, own).select(*FEATURES, "label"), "train")
    low, high = train.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        scored = rows.withColumn("score", F.lit(float(low or 0.0)))
    else:
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features_")
        forest = RandomForestClassifier(featuresCol="features_", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=1.0)
        model = forest.fit(vector.transform(train))
        scored = model.transform(vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "ordinal", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op3_secrets(spark, sf_dir):
    """The findings that are left after false-positive removal."""
    return scan(read(spark, sf_dir, "documents")).where("is_secret").drop("is_secret")
