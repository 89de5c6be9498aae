"""Secret scans: patterns propose candidates, a random forest removes false positives; DataFrame and MLlib only.

The forest sees a candidate's length, its character transitions, its coverage by dictionary words, path marks and the
words before and after it. It is trained on labelled findings: a table of (value, before, after, label). Where none is
given, a built-in table is generated by rule: keys and tokens of many shapes beside identifiers, digests, numbers,
placeholders and long words.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, spare

# Words that name a secret, words that name harmless values, and common words of prose and of names in code.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "signing_key", "client_secret")
HARMLESS_WORDS = ("example", "sample", "dummy", "placeholder", "test", "uuid", "guid", "sha1", "sha256", "md5", "commit", "checksum", "digest", "etag", "hash", "order", "invoice", "phone", "version", "build", "isbn", "id")
DICTIONARY = (
    "about after all also and are back before between both can change come find first for from get has have her into know last life made make man many may more move name need new next not now "
    "number open other our out over part people set should show than that the their them then they this time water week when where which who will with word work world year you your aber auch auf "
    "das dem den der die ein eine ist mit nicht sich sie und von que les des une pour dans est pas sur con del para por una como los las access account action address application archive array "
    "build cache change channel class client code column config content count create data database date default delete document download error event field file filter folder group handler header "
    "image index input item key language list load local main manager message method model module network node object option order output page param path process product profile project property "
    "query read record release report request resource response result return row sample schema script search send server service session setting source start state status storage store"
).split()

_KEYED = "(?:" + "|".join(sorted(SECRET_WORDS, key=len, reverse=True)) + ")"
#: A run of 16 and more key characters with a digit; '=' is in it as trailing padding only, so that NAME= is no part.
_RUN = r"(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{16,}+(?:={1,3}(?![A-Za-z0-9_+/=\-]))?"
#: In this order: a private key in armour, whole; what follows `Bearer`; the password in an address; any value of 8 and
#: more after a secret's name and an assignment (a run, if one ends there); a run anywhere.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[^\-]*+-----END [A-Z0-9 ]*PRIVATE KEY-----"
    r"|(?<= )(?<=(?i:bearer) )[A-Za-z0-9._~+/\-]{16,}+={0,3}"
    r"|(?<=:)(?<=://[^\s/:@\"']{1,256}:)[^\s/@\"']{8,}(?=@)"
    r"|(?<=[:=\s\"'])(?<=(?i:" + _KEYED + r")[\"']{0,1}[ \t]{0,3}[:=]{1,2}[ \t]{0,3}[\"']{0,1})(?![:=])"
    r"(?:" + _RUN + r"(?=$|[\s\"'&,;)\]}<>]|\.(?:\s|$))|(?!(?i:bearer)\s)[^\s\"']{8,})"
    r"|(?<![A-Za-z0-9_+/\-])" + _RUN
)
MAYBE = r"[0-9]|(?i:" + _KEYED + ")|://|PRIVATE KEY"
#: What is right before a value that is given as a secret.
_BEFORE = _KEYED + r"[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?$|bearer $|://[^\s/:@]+:$"
#: Characters of a value that are split at a time.
PIECE = 1 << 16
FEATURES = ("length", "digits", "upper", "lower", "other", "turns", "letter_turns", "vowel_turns", "longest_run", "variety", "entropy", "hex_only", "dictionary", "slashes", "path_before", "keyed", "secret_word", "harmless_word", "quoted", "dashes_like_uuid", "prefix_word")


def _share(count: Column, of: Column) -> Column:
    return count.cast("double") / F.greatest(of, F.lit(1))


def with_features(findings: DataFrame) -> DataFrame:
    """value, before and after -> one double for each of FEATURES."""
    v, low = F.col("value"), F.lower("value")
    before, after = F.lower("before"), F.lower("after")
    n = F.length(v)
    count = lambda pattern, of=v: F.regexp_count(of, F.lit(pattern))
    # The distinct characters, piece by piece: an array of all characters of a long value would be large.
    piece = lambda i: F.array_distinct(F.split(F.substring(v, i + 1, F.lit(PIECE)), ""))
    chars = F.array_remove(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE)), piece))), "")
    share = lambda c: _share(n - F.length(F.replace(v, c, F.lit(""))), n)
    entropy = F.aggregate(F.transform(chars, share), F.lit(0.0), lambda a, p: a - p * F.log2(F.greatest(p, F.lit(1e-9))))
    words = lambda of, which: F.least(count(r"(?<![a-z])(?:" + "|".join(sorted(which, key=len, reverse=True)) + ")", of), F.lit(3))
    exprs = {
        "length": F.log1p(n), "digits": _share(count("[0-9]"), n), "upper": _share(count("[A-Z]"), n), "lower": _share(count("[a-z]"), n), "other": _share(count("[^A-Za-z0-9]"), n),
        "turns": _share(count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), n), "letter_turns": _share(count("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), n), "vowel_turns": _share(count("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]", low), n),
        "longest_run": _share(F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(r"((.)\2+)"), F.lit(1)), lambda x: F.length(x))), F.lit(1)), n),
        "variety": _share(F.size(chars), F.least(n, F.lit(64))), "entropy": entropy, "hex_only": F.rlike(v, F.lit("^[0-9a-fA-F]+$")).cast("double"),
        "dictionary": 1 - _share(F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")), n),
        "slashes": _share(count("[/\\\\]"), n), "path_before": F.rlike(before, F.lit(r"[/\\][^\s]{0,40}$|https?:|www\.")).cast("double"),
        "keyed": (F.rlike(before, F.lit(_BEFORE)) | F.startswith(v, F.lit("-----BEGIN"))).cast("double"), "secret_word": words(before, SECRET_WORDS).cast("double"), "harmless_word": (words(before, HARMLESS_WORDS) + words(after, HARMLESS_WORDS)).cast("double"),
        "quoted": F.rlike(before, F.lit("[\"']$")).cast("double"), "dashes_like_uuid": F.rlike(low, F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).cast("double"), "prefix_word": F.rlike(v, F.lit("^[A-Za-z]{2,5}[_-][A-Za-z0-9]{12,}$|^(?:AKIA|eyJ)")).cast("double"),
    }
    return findings.select("*", *(exprs[f].alias(f) for f in FEATURES))


def candidates(documents: DataFrame, context: int = 48) -> DataFrame:
    """One row per candidate: doc_id, n (1, 2, ... in the text), value, before and after.

    Every text is searched to its end. Null and empty texts have no candidate. before and after are the `context`
    characters of the text around the value, other candidates among them.
    """
    docs = documents.select("doc_id", "text").filter(F.rlike("text", F.lit(MAYBE)))
    found = docs.select("doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), F.split("text", CANDIDATE, -1).alias("between")).filter(F.size("values") > 0)
    # The text as a list: what is between, value, between, ... Of a long piece only the ends can be context.
    ends = lambda x: F.when(F.length(x) > 2 * context, F.concat(F.left(x, F.lit(context)), F.right(x, F.lit(context)))).otherwise(x)
    pair = lambda x, i: F.array(ends(x), ends(F.coalesce(F.get("values", i), F.lit(""))))
    found = found.select("doc_id", "values", F.flatten(F.transform("between", pair)).alias("pieces"))
    rows = found.select("doc_id", "pieces", F.posexplode("values").alias("i", "value"))
    # A value has 8 characters at least: so many pieces hold the context.
    reach, at = 2 * -(-context // 8) + 1, 2 * F.col("i") + 1
    first = F.greatest(F.lit(1), at - (reach - 1))
    before = F.array_join(F.slice("pieces", first, at - first + 1), "")
    after = F.array_join(F.slice("pieces", at + 2, F.lit(reach)), "")
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), "value", F.right(before, F.lit(context)).alias("before"), F.left(after, F.lit(context)).alias("after"))


def labelled_findings(spark: SparkSession, rows: int = 6000, part: int = 0) -> DataFrame:
    """The built-in table: value, before, after, label; each row follows from its number, and another part has others.

    Secrets are random characters in the forms that issuers give them; harmless values are names put together from
    words, digests and identifiers after words that say so, numbers, dates and placeholders. No text of a corpus is used.
    """
    h = F.sha2(F.concat(F.lit(f"finding {part} "), F.col("id").cast("string")).cast("binary"), 256)
    pick = lambda k, *of: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in of)), (F.pmod(F.xxhash64("id", F.lit(part), F.lit(k)), F.lit(len(of))) + 1).cast("int"))
    word = lambda k: pick(k, *DICTIONARY)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(h.cast("binary"), 256))), "[\r\n=]", "")
    plain64 = F.regexp_replace(b64, "[+/]", "x")
    number = F.lpad(F.pmod(F.xxhash64("id", F.lit(part)), F.lit(10**16)).cast("string"), 16, "4")
    snake = F.concat(word(20), F.lit("_"), word(21), F.lit("_"), word(22), F.lit("_"), F.substring(number, 1, 2))
    camel = F.concat(word(23), F.initcap(word(24)), F.initcap(word(25)), F.initcap(word(26)), F.substring(number, 1, 1))
    address = F.concat(word(27), F.lit("/"), word(28), F.lit("/"), word(29), F.lit("-"), F.substring(number, 1, 3), F.lit("/"), word(30))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    plain = F.concat(word(1), F.lit(" "), word(10), pick(11, " ", ", ", ". ", "\n"), word(12), F.lit(" "))
    good_name = F.concat(plain, pick(13, "", "my_", "db_", "export ", "aws_"), pick(2, *SECRET_WORDS, *(w.upper() for w in SECRET_WORDS)), pick(3, " = ", "=", ": ", " = \"", ": '", "=\"", "\": \""))
    good_place = pick(14, good_name, good_name, good_name, good_name, F.concat(plain, F.lit("Authorization: Bearer ")), F.concat(plain, F.lit("https://"), word(15), F.lit(":")))
    bad_name = F.concat(plain, pick(4, *HARMLESS_WORDS), pick(5, " = ", "=", ": ", " = \"", " "))
    armour = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n"), F.reverse(b64), F.lit("\n-----END RSA PRIVATE KEY-----"))
    phrase = F.concat(word(31), F.substring(number, 1, 4), pick(32, "!", "#", "_", "x"), F.initcap(word(33)))
    secret = pick(6, F.substring(h, 1, 40), F.substring(h, 1, 32), h, F.upper(F.substring(h, 1, 40)), F.substring(b64, 1, 40), F.substring(b64, 1, 24), F.substring(F.regexp_replace(plain64, "[0-9]", "k"), 1, 32), F.concat(F.lit("ghp_"), F.substring(plain64, 1, 40)), F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit("sk_live_"), F.substring(plain64, 1, 26)), F.concat(F.substring(plain64, 1, 20), F.lit("."), F.substring(h, 1, 30)), phrase)
    harmless = pick(7, uuid, number, snake, camel, address, F.lit("0000000000000000"), F.lit("xxxxxxxxxxxxxxxx0"), F.lit("your_token_goes_here_1"), F.concat(F.lit("changeme_"), word(34)), F.concat(F.lit("1."), F.substring(number, 1, 2), F.lit("--2024-01-01-build")), F.substring(h, 1, 40), h)
    fixed = F.rlike("value", F.lit("^0+$|xxxx|goes_here|changeme"))
    bare = F.pmod(F.xxhash64("id", F.lit(part), F.lit(8)), F.lit(4))
    label = F.col("id") % 2
    t = spark.range(rows).select("id", label.cast("double").alias("label"), F.when(label == 0, harmless).when(F.col("id") % 40 == 1, armour).otherwise(secret).alias("value"), bare.alias("bare"))
    named = (F.col("bare") == 0) | F.length("value").isin(40, 64)
    # Placeholders and names in code after a secret's name are harmless too.
    low = F.when(fixed & (F.col("bare") > 1), good_name).when(named, bad_name).otherwise(plain)
    issued = F.startswith("value", F.lit("-----BEGIN")) | F.rlike("value", F.lit("^(?:ghp_|AKIA|sk_live_)"))
    high = F.when(issued & (F.col("bare") > 0), plain).otherwise(good_place)
    return t.select("value", F.when(label == 1, high).otherwise(low).alias("before"), pick(9, "\" and", " for the", "", ".", "\", ", " as it", "\n", "'").alias("after"), "label")


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def scan(documents: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, n, length, value_sha256, keyed, score, secret. The value itself isn't given out."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(documents)))
    scored = model.transform(rows.select("doc_id", "n", "value", "keyed", "features"))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("doc_id", F.col("n").cast("long").alias("n"), F.length("value").cast("long").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), (F.col("keyed") > 0).alias("keyed"), score.alias("score"), (score >= threshold).alias("secret"))


def redacted(documents: DataFrame, model: RandomForestClassificationModel, mark: str = "<secret>", threshold: float = 0.5) -> DataFrame:
    """documents with every value found secret replaced in text; rows and columns stay, whatever their names.

    A row is changed by what is found in its own text: rows with no doc_id, or the same one, are told apart by number.
    """
    docs, row = numbered(documents, "rows")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs.select(F.col(row).alias("doc_id"), "text"))))
    bad = model.transform(rows).filter(F.get(vector_to_array("probability"), F.lit(1)) >= threshold)
    key, held = spare(docs.columns, "key_"), spare(docs.columns, "values_")
    values = bad.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("value").alias(held))
    out = docs.join(values, docs[row] == values[key], "left")
    longest = F.array_sort(F.coalesce(held, F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    return out.withColumn("text", F.aggregate(longest, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))).drop(row, key, held)


def op1(documents: DataFrame) -> DataFrame:
    """One row per candidate of every text, with the columns of scan, by a forest trained on the built-in findings.

    Null and empty texts have no row, repeated rows have theirs each, a null doc_id is given out as null; texts of any
    length are searched whole. Other columns are ignored; an empty table gives an empty result.
    """
    return scan(documents, train(labelled_findings(documents.sparkSession)))
