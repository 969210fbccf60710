"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are runs of 16 or more characters that secrets are written in; where 16 follow an =, a new one begins. Each is described by
its length, character transitions, dictionary coverage, path signs and neighbouring words. A random forest trained from
labelled findings tells secrets from hashes, identifiers, paths and words.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, shared_dir

CHARS = "A-Za-z0-9+/_-"
#: A run's part up to an = that 16 characters follow, or to its end. Shorter values stay with their names.
_SPLIT = f"[{CHARS}][={CHARS}]{{15}}"
CANDIDATE = f"(?:(?<![={CHARS}])|(?<==)(?=[{CHARS}]))(?=[={CHARS}]{{16}})(?![={CHARS}]{{0,15}}={_SPLIT})[{CHARS}]*+(?:=+(?!{_SPLIT})[{CHARS}]*+)*"
#: Up to so many characters before a candidate are its neighbourhood.
NEAR = 40
#: Words that identifiers, paths and examples are made of.
DICTIONARY = "account|address|admin|annotation|build|cache|change|class|client|color|column|commit|config|content|data|default|document|element|error|event|example|field|file|format|function|group|handler|header|height|html|http|image|index|item|label|layout|license|line|link|list|local|message|method|model|module|name|node|number|object|option|order|package|page|param|path|point|product|project|query|record|report|request|resource|response|result|script|section|select|server|service|session|source|string|style|system|table|template|test|text|time|title|type|update|user|value|version|video|view|width|window"
ABOUT_SECRETS = "key|token|secret|passw|pwd|auth|bearer|credential|private|apikey|aws"
ABOUT_OTHERS = "sha|md5|commit|uuid|guid|checksum|digest|hash|revision|build|version|isbn|order|invoice|phone|card|number|example|sample|dummy|placeholder"
FEATURES = ("length", "transitions", "digits", "upper", "distinct", "hex_only", "digits_only", "coverage", "longest_letters", "slashes", "dashes", "after_sign", "about_secrets", "about_others", "quoted")


def described(rows: DataFrame) -> DataFrame:
    """Adds a column for each of FEATURES to rows(before, candidate)."""
    c, low, near = F.col("candidate"), F.lower("candidate"), F.lower("before")
    n = F.length(c).cast("double")
    count = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern)).cast("double")
    yes = lambda cond: cond.cast("double")
    words = F.length(F.regexp_replace(low, DICTIONARY, ""))
    return rows.withColumns(
        {
            "length": n,
            "transitions": count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])") / n,
            "digits": count("[0-9]") / n,
            "upper": count("[A-Z]") / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "hex_only": yes(F.rlike(c, F.lit("^[0-9a-fA-F-]+$"))),
            "digits_only": yes(F.rlike(c, F.lit("^[0-9-]+$"))),
            "coverage": (n - words) / n,
            "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[a-z]+|[A-Z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
            "slashes": count("/"),
            "dashes": count("[-_]"),
            "after_sign": yes(F.rlike(near, F.lit("[=:]\\s*[\"']?$"))),
            "about_secrets": yes(F.rlike(near, F.lit(ABOUT_SECRETS))),
            "about_others": yes(F.rlike(near, F.lit(ABOUT_OTHERS))),
            "quoted": yes(F.rlike(near, F.lit("[\"']$"))),
        }
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth (from 0), before and candidate of every candidate in every whole text.

    Only texts that hold one are searched with their neighbourhoods."""
    t = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).filter(F.rlike("text", F.lit(CANDIDATE)))
    before = F.transform(F.split("text", CANDIDATE, -1), lambda x: F.substring_index(F.right(x, F.lit(NEAR)), "\n", -1))
    both = F.arrays_zip(before.alias("before"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("candidate"))
    # what follows the last candidate has none
    return t.select("doc_id", F.posexplode(both).alias("nth", "f")).select("doc_id", "nth", F.col("f.before").alias("before"), F.col("f.candidate").alias("candidate")).filter("candidate is not null")


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """before, candidate and label of n findings made from hashes: keys, tokens and passwords (1); digests, identifiers,
    numbers, paths, names, words and lines (0). A quarter of both have no digit. The same rows for the same seed, in any partitioning."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(f"{seed}/{salt}"), i.cast("string")), 256)
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    base64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[+/=]", "x")
    word = lambda salt: pick(salt, DICTIONARY.split("|"))
    secret = F.when(i % 10 < 4, F.substring(h("t"), 1, 40)).when(i % 10 < 6, F.concat(F.lit("AKIA"), F.upper(F.substring(base64, 1, 16)))).when(i % 10 < 8, F.concat(pick("p", ["ghp_", "sk-", "xoxb-", ""]), F.substring(base64, 1, 36))).otherwise(F.base64(F.unhex(F.substring(h("s"), 1, 60))))
    about = F.concat(pick("a", ["", "the ", "set ", "my "]), pick("k", ["api_key", "token", "secret", "password", "auth_token", "aws_key", "access key", "private_key"]), pick("e", [" = \"", ": ", "=", ": '", " "]))
    other = (
        F.when(i % 7 == 0, F.concat_ws("-", *[F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
        .when(i % 7 == 1, F.substring(h("c"), 1, 40))
        .when(i % 7 == 2, F.lpad(F.regexp_replace(F.conv(F.substring(h("n"), 1, 15), 16, 10), "-", ""), 16, "4"))
        .when(i % 7 == 3, F.concat(word("w1"), F.lit("/"), word("w2"), F.lit("/"), word("w3"), F.substring(h("d"), 1, 2), F.lit("9")))
        .when(i % 7 == 4, F.concat(word("w4"), F.initcap(word("w5")), F.initcap(word("w6")), F.lit("Number"), (i % 90).cast("string"), F.lit("1")))
        .when(i % 7 == 5, F.substring(h("m"), 1, 32))
        .otherwise(F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("-"), word("w7"), F.lit("-"), word("w8")))
    )
    near = pick("o", ["commit ", "sha256: ", "md5 = ", "uuid ", "see ", "order ", "the ", "in ", "card ", "checksum: ", "id ", "of the ", "", "path: "])
    letters, bare = F.translate(base64, "0123456789", "QwErTyUiOp"), F.pmod(F.xxhash64(F.lit("bare"), i), F.lit(4)) == 0
    syllables = F.translate(F.substring(h("y"), 1, 36), "0123456789", "tionersahl")
    secret = F.when(~bare, secret).when(i % 4 == 0, F.concat_ws("-", *[word(f"v{k}") for k in range(4)])).otherwise(F.concat(pick("p", ["ghp_", "sk-", "xoxb-", ""]), F.substring(letters, 1, 36)))
    other = (
        F.when(~bare, other)
        .when(i % 6 == 0, F.concat_ws("/", F.lit(""), *[word(f"x{k}") for k in range(5)]))
        .when(i % 6 == 1, F.concat(word("x5"), F.initcap(word("x6")), F.initcap(word("x7")), F.lit("Handler")))
        .when(i % 6 == 2, F.concat_ws("_", word("x8"), word("x9"), word("y1"), F.lit("name")))
        .when(i % 6 == 3, F.repeat(pick("l", ["-", "=", "_", "/"]), (i % 60 + 16).cast("int")))
        .otherwise(F.substring(syllables, 1, (i % 11 + 16).cast("int")))
    )
    near = F.when(bare & (F.pmod(F.xxhash64(F.lit("close"), i), F.lit(5)) == 0), pick("c", ["the key to ", "a secret ", "token of ", "author: ", "passwords and "])).otherwise(near)
    label = (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2)) == 0).cast("double")
    return spark.range(n).select(F.when(label == 1, about).otherwise(near).alias("before"), F.when(label == 1, secret).otherwise(other).alias("candidate"), label.alias("label"))


def train(findings: DataFrame, trees: int = 30, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from findings(before, candidate, label), the same one for the same rows.

    It is written to the shared folder and read again: the model that `fit` returns holds its training summary, and with that
    the session, which must not go to the tasks."""
    dealt = described(findings.repartition(8, "candidate", "before", "label").sortWithinPartitions("candidate", "before", "label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(dealt).select("features", "label")
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    path = f"{shared_dir(findings.sparkSession)}/forest-{uuid.uuid4().hex}"
    fitted.write().save(path)
    return RandomForestClassificationModel.load(path)


def probability(model: RandomForestClassificationModel) -> Column:
    return vector_to_array(F.col("probability"))[1]


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth, candidate, score and is_secret of every candidate of every row of docs.

    Null and empty texts have none. Rows that repeat an id give their candidates each. An empty table gives an empty
    result; only id and text are read. The forest's size depends on its parameters alone.
    """
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(candidates(docs, id_col, text_col)))
    return model.transform(rows).select("doc_id", "nth", "candidate", probability(model).alias("score")).withColumn("is_secret", F.col("score") >= least)
