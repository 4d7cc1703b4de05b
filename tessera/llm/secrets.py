"""Operator 3: secret scans with a random forest that removes false positives.

Candidates are values that follow a credential's name and a sign of assignment
(six characters or more of any kind, with blanks if quoted), the password of an
address with a user's name, three-part tokens, and runs of 16 or more characters of keys that hold a digit or change case
within. Features: length, transitions between kinds of characters, coverage by
dictionary words, signs of a path, and the neighbouring words. A random forest,
trained from labelled findings, decides which candidates are secrets.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import KEY, aside, keyed

#: The name of a credential, what may stand between it and its value, what a candidate looks like (a quoted or bare value, a token of two
#: or three parts, a run of key characters), and how many characters beside it are looked at. Up to 40 letters may follow a credential's key word in its
#: name, and a user's name in an address has 64 characters at most, as what stands before a candidate must be of bounded length.
NAMES = r"(?i:passw|pwd|passphrase|secret|token|api.?key|access.?key|private.?key|credential|auth.?key)[A-Za-z_]{0,40}[\x22\x27\x60]?"
QUOTE, BESIDE = r"[\x22\x27\x60]", 40
ASSIGNED = rf"{NAMES}\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}"
CANDIDATE = "|".join([
    rf"(?<=[:=]>?\s{{0,3}}{QUOTE})(?<={ASSIGNED}{QUOTE})[^\x22\x27\x60\n]{{6,}}(?={QUOTE})",
    rf"(?<=[:=]>?\s{{0,3}})(?<={ASSIGNED})[^\s\x22\x27\x60<>,;(){{}}\[\]]{{6,}}",
    r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@]{6,}(?=@)",  # the first look behind spares all other places the second
    r"eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{4,}){1,2}",
    r"[A-Za-z0-9_+/\-]{16,}",
])
#: What a candidate must have, or stand after.
STRONG, AFTER = r"[0-9]|[a-z][A-Z].*[a-z][A-Z]", rf"{ASSIGNED}{QUOTE}?$"
#: Neighbouring words that speak for a secret, for another kind of string, and for a placeholder.
SECRET_WORDS = "token|secret|api.?key|access.?key|private.?key|passw|pwd|auth|bearer|credential|client.?key|signing"
OTHER_WORDS = "commit|sha-?[0-9]|md5|checksum|digest|uuid|guid|revision|version|etag|build|order|phone|call|card|invoice|id\\b"
SAMPLE_WORDS = "example|sample|dummy|placeholder|your.|xxxx|changeme|fake|redacted|test"
#: Dictionary words that identifiers are made of.
DICTIONARY = "the|and|for|with|from|this|that|have|your|here|name|user|file|path|data|time|date|test|example|sample|key|token|secret|value|index|config|service|handler|manager|request|response|client|server|table|column|image|model|train|batch|version|module|package|release|http|https|www|html|json|list|array|string|number|object|function|class|method|return|import|export|default|public|private|static|final|main|init|load|save|read|write|open|close|start|stop|get|set|new|old|max|min|sum|count|error|debug|info|warn|log|report|page|link|item|order|group|field|form|view|update|delete|create|insert|select|query|result"
MARK = "[SECRET]"
#: Parameters: the labelled findings the forest is trained from (a bound on its training), its trees and their depth, the least probability.
LABELLED, TREES, DEPTH, SEED, LEAST = 9000, 20, 8, 3, 0.5

FEATURES = ["length", "transitions", "digits", "capitals", "distinct", "hexadecimal", "consonants", "coverage", "slashes", "path", "extension", "secret_words", "other_words", "sample_words", "assigned", "quoted", "continues", "prefix", "signs", "letters", "blanks", "named"]


def features(found: DataFrame) -> DataFrame:
    """``found`` (candidate, before, after) with the forest's features."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count("candidate", F.lit(pattern)) / n
    before, near = F.col("before"), F.lower(F.concat_ws(" ", "before", "candidate"))
    columns = {
        "length": n,
        "transitions": share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40)),
        "hexadecimal": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "consonants": share("(?i)[bcdfghjklmnpqrstvwxz]{4}"),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), f"({DICTIONARY})", "")) / n,
        "slashes": F.regexp_count("candidate", F.lit("/")),
        "path": before.rlike(r"(https?:/?/?|[/\\.~@])[^\s\"'=]{0,30}$").cast("int"),
        "extension": F.col("after").rlike(r"^\.[a-z]{1,5}\b|^[/@]").cast("int"),
        "secret_words": F.lower(before).rlike(f"({SECRET_WORDS})[^\\s]{{0,12}}[\\s:=\"'>]{{0,6}}$").cast("int"),
        "other_words": F.lower(before).rlike(f"({OTHER_WORDS})[^\\s]{{0,12}}[\\s:=\"'>]{{0,6}}$").cast("int"),
        "sample_words": near.rlike(f"({SAMPLE_WORDS})").cast("int"),
        "assigned": before.rlike(r"[:=]\s{0,2}[\"'`]?$|(?i)bearer $").cast("int"),
        "quoted": before.rlike("[\"'`]$").cast("int"),
        "continues": before.rlike(r"PRIVATE KEY-----\s+$|[A-Za-z0-9+/]{32,}\r?\n$|[A-Za-z0-9_\-]{16,}\.$").cast("int"),
        "prefix": c.rlike("^(gh[pousr]_|glpat-|AKIA|sk[-_]|xox[abp]-|eyJ)").cast("int"),
        "signs": share("[^A-Za-z0-9 ]"),
        "letters": c.rlike("^[A-Za-z]+$|^[A-Z_]+$|^[A-Za-z]+[.:][A-Za-z_.:]+$").cast("int"),
        "blanks": F.regexp_count("candidate", F.lit(" ")),
        "named": before.rlike(AFTER).cast("int"),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: int = SEED) -> DataFrame:
    """(candidate, before, after, label, n): findings of the common kinds, made from hashes, secrets 1 and others 0."""
    text = lambda salt: F.sha2(F.concat_ws("-", F.lit(f"{seed}{salt}"), "n"), 512)
    pick = lambda salt, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.abs(F.xxhash64(F.lit(f"{seed}{salt}"), "n")) % len(values) + 1).cast("int"))
    number = lambda salt, low, high: (F.abs(F.xxhash64(F.lit(f"{seed}{salt}"), "n")) % (high - low + 1) + low).cast("int")
    hexa = F.substring(text("h"), F.lit(1), pick("hl", 32, 40, 40, 48, 64))
    hexa = F.when(number("u", 0, 5) == 0, F.upper(hexa)).otherwise(hexa)
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex(text("b"))), "[+/=]", "x7"), F.lit(1), number("bl", 18, 64))
    words = F.concat(*[x for i in range(4) for x in (pick(f"w{i}", *DICTIONARY.split("|")), pick(f"j{i}", "_", "-", "", "2", "/"))], number("wn", 1, 999).cast("string"))
    digits = F.substring(F.regexp_replace(text("d"), "[a-f]", ""), F.lit(1), number("dl", 16, 20))
    uuid = F.concat_ws("-", *[F.substring(text("i"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lead = pick("x", "The page said ", "and then ", "in of the ", "x = 1\n", "", "on river ")
    key = pick("k", "token", "api_key", "secret", "password", "access key", "auth_token", "client_secret", "TOKEN", "private_key", "Bearer", "AWS_SECRET_ACCESS_KEY", "GITHUB_PERSONAL_TOKEN", "google_client_secret")
    sign = pick("s", ' = "', '="', ": ", "=", " = '", ': "', " ")
    other = pick("o", "commit ", "sha256:", "md5 ", "checksum = ", "uuid: ", "revision ", "etag: ", "build=", "order ", "id=", "call ", "", "", "")
    path = pick("p", "https://site.org/", "/usr/lib/", "see www.", "src/main/", "./data/", "img/")
    line = F.substring(F.base64(F.unhex(text("p"))), F.lit(1), F.lit(64))
    form = number("f", 0, 5)  # of the fifth kind: parts of a JWT, lines of a PEM block, bare prefixes, others
    kind = F.abs(F.xxhash64(F.lit(seed), "n")) % 14
    plain = ["correct", "horse", "battery", "staple", "hunter", "dragon", "summer", "winter", "monkey", "sunshine", "river", "castle"]
    four = [pick(f"q{i}", *plain) for i in range(4)]
    short = F.when(number("sk", 0, 2) == 0, F.concat(four[0], number("sn", 1, 2026).cast("string"), pick("ss", "!", "", "#", "$", "?"))).when(number("sk", 0, 2) == 1, F.concat(F.substring(mixed, F.lit(1), number("s1", 3, 7)), pick("sm", "!", "@", "-", "%", "_"), F.substring(mixed, F.lit(9), number("s2", 3, 7)))).otherwise(F.substring(mixed, F.lit(1), number("s3", 8, 15)))
    phrase = F.when(number("pj", 0, 2) == 0, F.concat_ws("-", *four)).otherwise(F.concat_ws(" ", *four))
    common = pick("c", "required", "string", "undefined", "optional", "os.environ", "process.env.TOKEN", "settings.SECRET", "config.get", "encrypted", "nothing", "missing", "password", "disabled", "enabled", "integer", "generated", "hidden", "supported", "unknown", "invalid", "********", "getpass.getpass", "rotated weekly", "see the docs", "must be set")
    capitals = F.concat(*[F.initcap(pick(f"u{i}", *DICTIONARY.split("|"))) for i in range(4)])
    candidate = F.when(kind < 3, hexa).when((kind == 4) & (form == 2), line).when((kind == 4) & (form == 3), F.concat(pick("bp", "ghp_", "glpat-", "AKIA", "sk_live_", "xoxb-"), mixed)).when(kind < 5, mixed).when(kind == 5, hexa).when(kind == 10, short).when(kind == 11, phrase).when(kind == 12, common).when(kind == 13, capitals).when(kind == 6, words).when(kind == 7, F.when(number("g", 0, 1) == 0, digits).otherwise(uuid)).when(kind == 8, F.concat(words, F.substring(mixed, 1, 8))).otherwise(F.concat(pick("e", "your_api_key_here_", "example_token_value_", "xxxxxxxxxxxxxxxx", "dummy-secret-key-"), number("en", 1, 99)))
    jwt = F.when(number("j", 0, 1) == 0, "Bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.").otherwise(F.concat(F.substring(line, 1, 48), F.lit(".")))
    pem = F.when(number("j", 0, 3) == 0, "-----BEGIN RSA PRIVATE KEY-----\n").otherwise(F.concat(F.substring(F.base64(F.unhex(text("q"))), 1, 64), F.lit("\n")))
    before = F.when((kind == 4) & (form == 1), jwt).when((kind == 4) & (form == 2), pem).when((kind == 4) & (form == 3), lead).when(kind == 11, F.concat(lead, key, pick("sq", ' = "', '="', ": '", '": "'))).when((kind < 5) | (kind == 9) | (kind == 10) | (kind == 12), F.concat(lead, key, sign)).when(kind == 8, F.concat(lead, path)).when(kind == 5, F.concat(lead, pick("o5", "commit ", "sha256:", "md5 ", "checksum = ", "revision ", "etag: ", "digest: "))).otherwise(F.concat(lead, other))
    after = F.when(before.rlike("[\"']$"), F.right(before, F.lit(1))).when(kind == 8, pick("a", ".html", ".py", "/", ".png", " ")).otherwise(pick("t", " ", "\n", "", " of"))
    rows_ = spark.range(rows).select(F.col("id").alias("n")).coalesce(4)
    return rows_.select("n", candidate.alias("candidate"), F.right(before, F.lit(BESIDE)).alias("before"), after.alias("after"), ((kind < 5) | (kind == 10) | (kind == 11)).cast("double").alias("label"))


def train(labelled: DataFrame) -> PipelineModel:
    """The forest of ``labelled`` (candidate, before, after, label); null neighbours are empty."""
    rows = features(labelled.na.fill("", ["before", "after"])).select(*FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate of keyed ``docs``: key, doc_id, its number, start (code points), itself and what stands beside it."""
    rows = docs.where(F.col("text").rlike(CANDIDATE)).select(*KEY, "doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("hits"), F.split("text", CANDIDATE).alias("between"))
    # The text before a candidate, earlier candidates included: seven of them, of six characters at least, fill BESIDE.
    pieces = [f"right(coalesce(get({c}, i - {k}), ''), {BESIDE})" for k in (7, 6, 5, 4, 3, 2, 1) for c in ("between", "hits")]
    before = f"right(concat({', '.join([*pieces, f'right(between[i], {BESIDE})'])}), {BESIDE})"
    each = rows.select(*KEY, "doc_id", F.posexplode(F.expr(f"transform(hits, (x, i) -> named_struct('candidate', x, 'gap', length(between[i]), 'before', {before}, 'after', left(between[i + 1], {BESIDE})))")).alias("number", "h")).select(*KEY, "doc_id", "number", "h.*")
    earlier = Window.partitionBy(*KEY).orderBy("number")  # of one document each
    start = F.sum("gap").over(earlier) + F.coalesce(F.sum(F.length("candidate")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("start", start.cast("long")).where(F.col("candidate").rlike(STRONG) | F.col("before").rlike(AFTER)).drop("gap")


def scan(docs: DataFrame, model: PipelineModel | None = None, has_keys: bool = False) -> DataFrame:
    """A row for each candidate in ``docs`` (doc_id, text): key, doc_id, number, start, length, candidate, probability, is_secret.

    Null, empty or other texts without a candidate give no rows, as an empty
    table; a candidate that repeats gives a row each time; other columns are
    ignored; texts are scanned whole. Without a model one is trained from
    :func:`labelled_findings`.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    scored = model.transform(features(candidates(docs if has_keys else keyed(docs.select("doc_id", "text")))))
    p = vector_to_array("probability")[1]
    return scored.select(*KEY, "doc_id", "number", "start", F.length("candidate").cast("long").alias("length"), "candidate", p.alias("p")).withColumn("is_secret", F.col("p") >= LEAST).withColumnRenamed("p", "probability")


def redact(docs: DataFrame, model: PipelineModel | None = None, mark: str = MARK) -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; a column n_chars follows the text.

    Null, empty and other texts without a candidate stay as they are, repeated
    rows each lose theirs, an empty table gives no rows, and all columns come
    back, whatever their names.
    """
    inner, back = aside(docs, ["doc_id", "text", "n_chars"])
    rows = keyed(inner)
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    found = scan(rows, model, has_keys=True).where("is_secret").groupBy(*KEY).agg(F.collect_set("number").alias("_numbers"))  # of one document each
    some = rows.where(has).join(found, KEY, "left")
    text = F.expr(f"""array_join(transform(array(named_struct('h', regexp_extract_all(text, '{CANDIDATE.replace(chr(92), chr(92) * 2)}', 0), 'b', split(text, '{CANDIDATE.replace(chr(92), chr(92) * 2)}'))), z ->
        array_join(transform(z.b, (b, i) -> concat(b, if(i >= size(z.h), '', if(array_contains(_numbers, i), '{mark}', z.h[i])))), '')), '')""")
    some = some.withColumn("text", F.when(F.col("_numbers").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("_numbers").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return back(some).unionByName(back(rows.where(~has)))
