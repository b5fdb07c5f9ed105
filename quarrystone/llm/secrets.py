"""Secrets: candidates by pattern, false positives removed by a random forest (DataFrame and ML functions only)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, whole
from .spans import match_spans

# Candidates: what follows the name of a secret and a sign, of six characters or more, whatever they are; runs with a
# provider's prefix; and any run of twelve or more key characters with a digit, as ordinary words have none.
NAMED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\"']?[ \t]{0,2}(?:=>|:=|=|:)[ \t]{0,2}[\"']?"
VALUE = r"[^\s\"'`,;<>()]{5,}[^\s\"'`,;<>().!?:]"
PREFIXED = r"(?<![A-Za-z0-9_])(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|xox[abp]-|AIza|SG_|npm_|dop_v1_)[A-Za-z0-9_\-]{12,}"
CANDIDATE = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{12,}+={0,2}"
#: All three; the first two are only tried on texts that hold one of them, as looking back from each character is slow.
WIDE = rf"(?<={NAMED}){VALUE}|{PREFIXED}|{CANDIDATE}"
BEFORE, AFTER = 40, 24

# Words of the trade, as patterns.
KEY_WORDS = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
HASH_WORDS = r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|uuid|guid|etag|revision|isbn|order|invoice|card|phone|serial)"
PLACEHOLDERS = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|foobar|redacted|0{6}|1234567)"
PROVIDERS = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|xox[abp]-|AIza|SG_|npm_|dop_v1_)"
DICTIONARY = "about above account action admin after allow array backup batch before black block board button cache change check child class client close cloud color column config content count create daily data date default delete detail device draft email empty error event export false field file final first folder form frame group guide handler header height home host image import index input instance item label language large layout level limit line link list load local login main manager master media member menu message method minor mobile model module month name network node normal note number object open option order output owner page panel parent part path pattern phone photo point policy position post price print private process product profile project public query queue random range reader record region release remote report request reset result return review right role route rule sample save schema score screen script search section select server service session setting shadow share simple size small source stage start state static status step store stream string style system table target task template test text theme thread time title token total track true type unique update upload user value version video view width window world write".split()

FEATURES = (
    "length", "digits", "uppers", "symbols", "transitions", "distinct", "covered", "vowels", "hex_only", "digits_only", "uuid", "provider",
    "placeholder", "key_before", "assigned", "quoted", "hash_before", "in_path", "url", "file_after",
)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """What the forest looks at: length, character transitions, dictionary coverage, path and neighbouring words."""
    n = F.length(value)
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    left = F.length(F.regexp_replace(F.lower(value), words, ""))
    flag = lambda c: c.cast("double")
    near = F.right(before, F.lit(24))
    made = {
        "length": F.least(n, F.lit(200)).cast("double"),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])"),
        "distinct": F.size(F.array_distinct(F.split(F.left(value, F.lit(200)), "(?!^)"))) / F.least(n, F.lit(40)),
        "covered": 1 - left / n, "vowels": share("[aeiouAEIOU]"),
        "hex_only": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "digits_only": flag(value.rlike("^[0-9-]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "provider": flag(value.rlike(PROVIDERS)), "placeholder": flag(value.rlike(PLACEHOLDERS) | before.rlike(PLACEHOLDERS)),
        "key_before": flag(near.rlike(KEY_WORDS)), "assigned": flag(near.rlike("[:=]\\s*[\"']?$")), "quoted": flag(near.rlike("[\"']$") & after.rlike("^[\"']")),
        "hash_before": flag(near.rlike(HASH_WORDS)), "in_path": flag(value.contains("/") | near.rlike("[/\\\\.]$")),
        "url": flag(before.rlike("(?i)(?:https?|ftp)://\\S*$")), "file_after": flag(after.rlike("^\\.[a-z]{2,4}\\b")),
    }
    return [made[f].cast("double").alias(f) for f in FEATURES]


def seed_findings(spark: SparkSession, rows: int = 9_000) -> DataFrame:
    """Labelled findings (value, before, after, secret) made by rule: kinds of keys with the words they come with, and
    what is taken for keys: hashes, ids, card and serial numbers, identifiers, paths, placeholders, plain words."""
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda salt, choices: F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(choices))) + 1).cast("int"))
    mixed_case = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[=]", "")
    upper = lambda salt: F.upper(F.regexp_replace(F.base64(F.unhex(h(salt))), "[^A-Za-z0-9]", ""))
    size = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("int")
    digits = lambda salt: F.regexp_replace(h(salt), "[^0-9]", "")
    word = lambda salt: pick(salt, DICTIONARY)
    key = pick("k", ["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key"])
    sign = pick("s", ["=", " = ", ": ", ":", '="', ' = "', ": '"])
    prose = F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(" "))
    kinds = [
        (F.substring(h("a"), 1, 18), F.concat(prose, key, sign), F.lit(""), 1),
        (F.substring(h("a"), F.lit(1), size("l", 12, 64)), F.concat(prose, key, sign), F.lit('"'), 1),
        (F.substring(mixed_case("a"), F.lit(1), size("l", 14, 43)), F.concat(prose, key, sign), F.lit(""), 1),
        (F.concat(F.lit("AKIA"), F.substring(upper("a"), 1, 16)), prose, F.lit(" "), 1),
        (F.concat(pick("g", ["ghp_", "gho_", "sk_live_", "npm_", "glpat-"]), F.substring(F.regexp_replace(mixed_case("a"), "[^A-Za-z0-9]", "x"), 1, 36)), prose, F.lit(" "), 1),
        (F.concat(F.lit("AKIA"), F.substring(upper("b"), 1, 16)), F.concat(prose, key, sign), F.lit(""), 1),
        (F.substring(h("a"), 1, 40), F.concat(prose, pick("h", ["commit ", "sha1 ", "revision ", "digest ", "checksum: "])), F.lit(" "), 0),
        (F.substring(h("a"), F.lit(1), size("l", 12, 64)), prose, F.lit(" "), 0),
        (F.concat_ws("-", F.substring(h("a"), 1, 8), F.substring(h("a"), 9, 4), F.substring(h("a"), 13, 4), F.substring(h("a"), 17, 4), F.substring(h("a"), 21, 12)), F.concat(prose, pick("u", ["uuid ", "id=", "guid: ", ""])), F.lit(" "), 0),
        (F.substring(digits("a"), F.lit(1), size("l", 12, 19)), F.concat(prose, pick("c", ["", "card ", "order ", "serial: ", "phone "])), F.lit(" "), 0),
        (F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c")), F.substring(digits("d"), 1, 2)), prose, pick("e", [" ", "(", ".py", ".js"]), 0),
        (F.concat(word("a"), F.lit("/"), word("b"), F.lit("/"), word("c"), F.substring(digits("d"), 1, 3)), F.concat(prose, pick("r", ["", "./", "https://", "/usr/"])), pick("e", [" ", ".html", ".png"]), 0),
        (pick("x", ["EXAMPLEKEY1234567890", "your-api-key-here-123", "xxxxxxxxxxxxxxx1", "changeme1234567", "dummy_token_000000", "test_password_12345"]), F.concat(prose, key, sign), F.lit(""), 0),
        (F.concat(F.lit("20"), F.substring(digits("a"), 1, 2), F.lit("-01-02-"), word("b"), F.lit("-"), word("c")), prose, F.lit(" "), 0),
        (F.substring(F.regexp_replace(mixed_case("a"), "[^A-Za-z]", "q"), F.lit(1), size("l", 16, 40)), F.concat(prose, key, sign), F.lit(""), 1),
        (F.concat(F.initcap(word("a")), F.initcap(word("b")), F.initcap(word("c"))), F.concat(prose, pick("w", ["password", "passwd", "passphrase", "pwd"]), sign), F.lit(""), 1),
        (F.concat(F.initcap(F.translate(word("a"), "aeo", "430")), pick("y", ["!", "&", "$", "#", "%"]), F.substring(digits("d"), 1, 3)), F.concat(prose, pick("w", ["password", "passwd", "pwd"]), sign), F.lit(""), 1),
        (F.concat(word("a"), F.substring(digits("d"), 1, 2), F.substring(h("e"), 1, 2)), F.concat(prose, pick("w", ["password", "passwd", "pwd"]), sign), F.lit(""), 1),
        (F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(upper("a"), "[0-9]", "Q"), 1, 16)), prose, F.lit(" "), 1),
        (F.concat(word("a"), pick("z", ["ing", "ation", "able", "ed", "ment", "ly", ""])), F.concat(prose, key, sign), pick("e", [" ", ".", "\n"]), 0),
        (F.concat(word("a"), pick("j", [".", "_", "-"]), word("b")), F.concat(prose, key, sign), F.lit(" "), 0),
        (pick("x", ["required", "optional", "undefined", "unknown", "changeme", "expired", "invalid", "missing", "hidden", "<none>"]), F.concat(prose, key, sign), pick("e", [" ", ".", ""]), 0),
    ]
    shape = F.lit(None).cast("struct<value:string,before:string,after:string,secret:int>")
    for i, (v, b, a, y) in enumerate(kinds):
        shape = F.when(F.pmod(F.col("id"), F.lit(len(kinds))) == i, F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(y).alias("secret"))).otherwise(shape)
    return spark.range(0, rows, 1, 4).select(shape.alias("x")).select("x.*").where(F.length("value") >= 6)


def fit_forest(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """findings (value, before, after, secret), a bounded table of reviewed candidates."""
    rows = findings.select(F.col("secret").cast("double").alias("label"), *features(F.col("value"), F.col("before"), F.col("after")))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points), value, before, after."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    text = F.col("text")
    rare = text.rlike(f"{NAMED}{VALUE}") | text.rlike(PREFIXED)
    some = texts.withColumn("rare", rare).where(F.col("rare") | text.rlike(CANDIDATE))
    spans = F.when(F.col("rare"), match_spans(text, WIDE)).otherwise(match_spans(text, CANDIDATE))
    found = some.select("doc_id", "text", F.explode(spans).alias("s"))
    start = F.col("s.start")
    return found.select(
        "doc_id", start.alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"),
        F.substring("text", F.greatest(F.lit(1), start + 1 - BEFORE), F.least(F.lit(BEFORE), start)).alias("before"),
        F.substring("text", F.col("s.end") + 1, F.lit(AFTER)).alias("after"),
    )


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, end, score, kept, value_sha256 (never the secret itself).

    ``findings`` are labelled candidates to learn from (default: seed_findings); a forest scores every candidate of
    every whole text, and what scores below cutoff is a false positive (kept = false). Null and empty texts have no
    candidates; repeated rows give theirs each time; null ids pass through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = fit_forest(checkpoint(findings if findings is not None else seed_findings(spark)))
    rows = candidates(docs, id_col, text_col)
    scored = rows.select("doc_id", "start", "end", "value", *features(F.col("value"), F.col("before"), F.col("after")))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scored)
    score = F.round(vector_to_array(F.col("probability"))[1], 6)
    return model.transform(vectors).select("doc_id", "start", "end", score.alias("score"), (score >= cutoff).alias("kept"), F.sha2("value", 256).alias("value_sha256"))
