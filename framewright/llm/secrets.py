"""Secret scans: a random forest that tells secrets from other tokens, as Catalyst expressions.

Candidates are values set beside the name of a credential, of any characters but marks that end them; tokens with a known
opening; and long runs of key-like characters with a digit. The forest sees a candidate's length and character
transitions, how much of it a dictionary covers, the document's path (its source) and the words beside it. It is
trained by Spark ML on labelled findings, then its trees are written out as nested comparisons, so a scan is a
projection over one row: no shuffle, no Python.
"""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings the forest is fitted on at most; trees, their depth and the seed.
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 15, 6, 7
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Characters beside a candidate that count as its neighbourhood.
BEFORE, AFTER = 48, 16

#: Names of credentials, as they stand before a value, and known openings of keys.
CREDENTIAL = r"(?i:passw(?:or)?d|passphrase|pass|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|credentials?|bearer|private[_ -]?key)"
KEY_OPENING = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)"
#: A value beside a credential's name, a token with a known opening, or a long run with a digit (padding may end it).
CANDIDATE = (
    r"(?<=[=:>]\s{0,4}[\"'`]{0,1})(?<=" + CREDENTIAL + r"[\"'`]{0,1}\s{0,4}(?:=|:|:=|=>|==)\s{0,4}[\"'`]{0,1})[^\s\"'`,;<>(){}\[\]|]{6,}(?<![.:])"
    r"|(?<![A-Za-z0-9])" + KEY_OPENING + r"[A-Za-z0-9_.-]{12,}(?<![.])"
    r"|(?<![A-Za-z0-9_+/~-])(?=[A-Za-z_+/~-]*+[0-9])[A-Za-z0-9_+/~-]{16,}+={0,2}"
)
#: Words and word parts of ordinary text and code, for dictionary coverage.
DICTIONARY = (
    "about account action after all also and api app are array ation back been before build but cache can change class client code com common config connection content control count "
    "data date debug default description dev document each element ement end ent error event example ever example fail field file filter first font for form from function get group "
    "have head height http image index info ing int item key label last length level like line link list load local log long main make manager map max media menu message method min model "
    "module more name network new news node not now number object one only open option order other out over page part path people place plus point post press process project property "
    "query read release report request response result right run sample script search second section self server service set should show side size sort source start state static status step "
    "stock storage store story string style system table tag target task test text than that the their then there these they thing this time tion title token top track tree type under unit update upload "
    "url use user utils value version very view was web week what when where which width will window with word work world would year you your"
).split()
#: Names of harmless digests and identifiers, and values that stand for a secret without being one.
HARMLESS_WORDS = "commit sha1 sha256 sha512 md5 checksum digest etag integrity uuid guid revision hash isbn phone tel card order invoice id"
PLACEHOLDER = r"(?i)^[$%#@&]|^(?:(.)\1+|(?:null|none|nil|undefined|true|false|required|optional|string)\W*)$|your|example|change_?me|placeholder|dummy|redacted|environ|getenv|env\.|\.\.\."
#: Paths where findings are mostly made up.
TEST_PATHS = r"(?i)test|spec|example|fixture|sample|mock|demo|docs?\b"

FEATURES = ("length", "digits", "upper", "lower", "symbols", "turns", "case_turns", "distinct", "hex", "dictionary", "known", "placeholder", "secret_word", "harmless_word", "assigned", "quoted", "in_url", "test_path")


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.char_length(c)


def features(c: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate, its neighbourhoods and its path, all doubles."""
    n = F.char_length(c)
    near = F.lower(before)
    words = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))

    def flag(x: Column) -> Column:
        return F.coalesce(x, F.lit(False)).cast("double")

    def any_of(x: str) -> str:
        return "(?:" + "|".join(w.replace("-", "\\-") for w in x.split()) + ")"

    return [
        n.cast("double"), _share(c, "[0-9]"), _share(c, "[A-Z]"), _share(c, "[a-z]"), _share(c, "[^A-Za-z0-9]"),
        F.regexp_count(c, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / n, F.regexp_count(c, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n,
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(36)), flag(c.rlike("^[0-9a-fA-F]+$")),
        F.lit(1.0) - F.char_length(F.regexp_replace(F.lower(c), words, "")) / n, flag(c.rlike("^" + KEY_OPENING)), flag(c.rlike(PLACEHOLDER)),
        flag(near.rlike(CREDENTIAL + r"[\w -]{0,12}\W{0,10}$")), flag(near.rlike(r"\b" + any_of(HARMLESS_WORDS) + r"\W{0,10}$")),
        flag(before.rlike(r"[:=]\W{0,6}$")), flag(before.rlike("[\"'`][^\\w\\s]*$") & after.rlike("^[^\\w\\s]*[\"'`]")),
        flag(before.rlike(r"(?:://|www\.)\S*$") | after.rlike("^@")), flag(path.rlike(TEST_PATHS)),
    ]


def labelled_texts(n: int = 4_000, seed: int = SEED) -> list[tuple[str, str, list[str]]]:
    """Made-up (text, path, secrets in it), one value a text, for where no labelled texts are given; half hold a secret.

    Values of a secret's shape in paths of tests and samples are labelled as none, as are placeholders.
    """
    r = random.Random(seed)
    hexes, letters, alnum, b64 = "0123456789abcdef", string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "th er an on in re ed at ing tion ent es or ch ung keit que ción eau ment ado los der die the and".split()
    names = ["token", "TOKEN", "api_key", "secret", "password", "access_key", "AUTH_TOKEN", "client_secret", "private key", "Bearer", "pwd", "DB_PASSWORD", "auth", "aws_secret_access_key"]
    real, made_up = ["src", "src3", "src14", "config", "web", "lib", "deploy", ""], ["test", "tests/unit", "spec", "examples", "fixtures", "docs", "demo"]

    def of(chars: str, k: int) -> str:
        return "".join(r.choice(chars) for _ in range(k))

    def word(k: int) -> str:
        return "".join(r.choice(syllables) for _ in range(k))

    def noise() -> str:
        return r.choice(["", "", "", of("#*$%&!|", 3), of("!#", 2)])

    def key() -> str:
        return r.choice([
            of(hexes, r.choice([32, 40, 40, 48, 64])), of(alnum, r.randint(20, 64)), of(b64, 40) + r.choice(["", "=", "=="]), word(2) + of(alnum, 16),
            r.choice(["ghp_", "sk-", "AKIA", "xoxb-", "npm_", "AIza", "glpat-"]) + of(r.choice([alnum, letters]), r.randint(16, 40)),
        ])

    def password() -> str:
        return r.choice([of(alnum + "!@#$%&*-_", r.randint(7, 24)), word(1) + of(string.digits, r.randint(1, 4)) + of("!@#$*", r.randint(0, 2)), word(2) + str(r.randint(1, 99)) + word(1), of(letters, r.randint(20, 36)), word(1).translate(str.maketrans("aeio", "4310")) + of(alnum, 3)])

    def assigned(value: str, name: str) -> tuple[str, str]:
        quote, mark = r.choice(['"', '"', '"', "'", ""]), r.choice([" = ", " = ", "=", ": ", ":"])
        before = f"{word(2)} {word(1)}{r.choice([' ', chr(10), '. ', '?'])}{name}{noise()}{mark.rstrip()}{noise()}{' ' if mark.endswith(' ') else ''}{quote}"
        return before, quote + noise() + r.choice([" ", "\n", ""] if quote else [" ", "\n"]) + word(2)

    rows = []
    for _ in range(n // 2):
        value, name = (key(), r.choice(names)) if r.random() < 0.65 else (password(), r.choice([x for x in names if x not in ("private key", "Bearer")]))
        if r.random() < 0.15:
            value = value.upper()
        before, after = assigned(value, name)
        if r.random() < 0.15:  # known openings tell a key in plain words too
            value, before, after = r.choice(["ghp_", "sk-", "AKIA", "xoxb-", "npm_", "AIza", "glpat-"]) + of(r.choice([alnum, letters, string.ascii_lowercase]), r.randint(16, 40)), f"{word(2)} {word(1)} ", r.choice([" ", ". ", "\n"]) + word(2)
        rows.append((before + value + after, r.choice(real if r.random() < 0.95 else made_up), [value]))
    for _ in range(n - n // 2):
        kind, quote, path = r.randrange(9), r.choice(["", "", '"']), r.choice(real + made_up)
        if kind == 0:
            value, before = of("0123456789", r.randint(16, 20)), word(2) + " " + r.choice(["", "card ", "phone: ", "order "])
        elif kind == 1:
            value, before = of(hexes, r.choice([32, 40, 64])), r.choice(["commit ", "sha256: ", "md5=", "checksum = ", "etag: ", "revision "]) + quote
        elif kind == 2:
            value, before = word(r.randint(4, 7)) + str(r.randint(0, 9999)), word(2) + r.choice([" ", ". ", ": ", " = "]) + quote
        elif kind == 3:
            value, before = "-".join([of(hexes, 8), of(hexes, 4), of(hexes, 4), of(hexes, 4), of(hexes, 12)]), r.choice(["uuid ", "id: ", "guid = ", word(2) + " "]) + quote
        elif kind == 4:
            value, before = "/".join(word(2) for _ in range(3)) + "/" + str(r.randint(1000, 99999)), r.choice(["https://www.", "see ", "http://"])
        elif kind == 5:
            value, before = "_".join(r.choice(DICTIONARY) for _ in range(4)) + str(r.randint(0, 99)), word(1) + r.choice([" ", " = ", "("])
        elif kind == 6:
            value = key() if r.random() < 0.6 else password()
            before, after = assigned(value, r.choice(names))
            rows.append((before + value + after, r.choice(made_up), []))
            continue
        else:
            plain = r.choice(DICTIONARY) + r.choice(["", "_", "."]) + r.choice(DICTIONARY)
            value = r.choice([plain, plain, word(r.randint(2, 4)), of("x", r.randint(6, 12)), "*" * r.randint(6, 10), "your_" + r.choice(DICTIONARY) + "_here", "change_me", "undefined", "required", "${" + of(string.ascii_uppercase, 6) + "}", "os.environ", "process.env.TOKEN", "example" + of(string.digits, 3)])
            before, after = assigned(value, r.choice(names))
            rows.append((before + value + after, path, []))
            continue
        rows.append((word(1) + " " + before + value + quote + r.choice([" ", "\n", ".", ")"]) + word(2), path, []))
    return rows


def findings_of(texts: DataFrame) -> DataFrame:
    """Labelled findings (candidate, before, after, path, label) of labelled texts (text, path, secrets): what a scan
    would see. A candidate is a secret if it is one of the text's secrets, holds one or is part of one."""
    own = F.exists("secrets", lambda x: F.contains(x, F.col("x.c")) | F.contains(F.col("x.c"), x))
    rows = _split(texts, "text").withColumn("x", F.explode(F.transform("__fw_c", lambda c, i: F.struct(c.alias("c"), *[n.alias(k) for k, n in zip(("b", "a"), _beside(i), strict=True)]))))
    return rows.select(F.col("x.c").alias("candidate"), F.col("x.b").alias("before"), F.col("x.a").alias("after"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(own, F.lit(False)).cast("double").alias("label"))


def labelled_findings(spark: SparkSession, n: int = 4_000, seed: int = SEED) -> DataFrame:
    """Findings of made-up labelled texts."""
    return findings_of(spark.createDataFrame(labelled_texts(n, seed), "text string, path string, secrets array<string>"))


def fit_forest(spark: SparkSession, findings: DataFrame | None = None):
    """(forest, rows that it was fitted on): labelled findings, made-up ones by default, at most TRAIN_ROWS of them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = findings if findings is not None else labelled_findings(spark)
    table = found.orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "after", "path", "label").limit(TRAIN_ROWS).coalesce(1)
    columns = [x.alias(n) for n, x in zip(FEATURES, features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path")), strict=True)]
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.select("label", *columns)).select("label", "features", *FEATURES)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows), rows


def train(spark: SparkSession, findings: DataFrame | None = None) -> list[tuple]:
    """Trees of the forest as nested tuples: a leaf's probability, or (feature, threshold, tree if at most the threshold, tree otherwise)."""
    return trees_of(fit_forest(spark, findings)[0])


def trees_of(model) -> list[tuple]:
    """A fitted forest's trees, see train."""

    def tree(node):
        if node.getClass().getSimpleName() == "LeafNode":
            no, yes = node.impurityStats().stats()
            return yes / (no + yes)
        split = node.split()
        return (split.featureIndex(), split.threshold(), tree(node.leftChild()), tree(node.rightChild()))

    return [tree(t._call_java("rootNode")) for t in model.trees]


def probability_sql(trees: list, values: str) -> str:
    """Mean of the trees' leaves as SQL, for the name of an array of feature values."""

    def sql(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        return f"IF({values}[{tree[0]}] <= {tree[1]!r}D, {sql(tree[2])}, {sql(tree[3])})"

    return f"({' + '.join(f'({sql(t)})' for t in trees)}) / {len(trees)}D"


def _let(frame: DataFrame, name: str, value: Column) -> DataFrame:
    return frame.withColumn(name, F.explode(F.array(value)))  # evaluated once, not once for each use


def _split(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __fw_c, its candidates, and __fw_pieces, the text around them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = _let(docs, "__fw_c", F.regexp_extract_all(text, F.lit(CANDIDATE), 0))
    return _let(df, "__fw_pieces", F.when(F.size("__fw_c") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))


def _beside(i: Column) -> tuple[Column, Column]:
    """What stands before and after candidate i."""
    whole = F.concat(F.when(i > 0, F.get("__fw_c", i - 1)).otherwise(F.lit("")), F.get("__fw_pieces", i))
    return F.right(whole, F.lit(BEFORE)), F.left(F.get("__fw_pieces", i + 1), F.lit(AFTER))


def with_findings(docs: DataFrame, trees: list, path_col: str | None = "source") -> DataFrame:
    """docs with two helper columns: __fw_pieces, the text between candidates, and __fw_found, an array over candidates.

    Joining pieces and candidates alternately gives the text back. Null texts have no candidates.
    """
    let = _let
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    df = _split(docs, "text")

    def values(c: Column, i: Column) -> Column:
        return F.array(*features(c, *_beside(i), path))

    df = let(df, "__fw_values", F.transform("__fw_c", values))
    df = let(df, "__fw_p", F.expr(f"transform(__fw_values, v -> {probability_sql(trees, 'v')})"))
    starts = F.aggregate(
        F.transform("__fw_c", lambda c, i: F.struct(F.char_length(F.get("__fw_pieces", i)).alias("gap"), F.char_length(c).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x["gap"])).alias("all")),
    )["all"]
    df = let(df, "__fw_starts", F.when(F.size("__fw_c") > 0, starts).otherwise(F.array().cast("array<int>")))
    found = F.transform("__fw_c", lambda c, i: F.struct(F.get("__fw_starts", i).alias("start"), c.alias("candidate"), F.get("__fw_p", i).alias("probability")))
    return df.withColumn("__fw_found", found).drop("__fw_c", "__fw_values", "__fw_p", "__fw_starts")


def scan(docs: DataFrame, trees: list, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, ordinal, start, length, sha256 of the candidate, probability, is_secret.

    start counts characters from 0. The candidate itself is not shown. Null and empty texts have no rows, repeated
    documents have theirs again, a null doc_id is carried.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["source"] if "source" in docs.columns else []))
    rows = with_findings(own, trees).select("doc_id", F.posexplode("__fw_found").alias("ordinal", "x"))
    p = F.round("x.probability", 9)
    return rows.select("doc_id", "ordinal", "x.start", F.char_length("x.candidate").alias("length"), F.sha2(F.col("x.candidate").cast("binary"), 256).alias("sha256"), p.alias("probability"), (p >= threshold).alias("is_secret"))


def redact(docs: DataFrame, trees: list, threshold: float = THRESHOLD) -> DataFrame:
    """docs, the same columns, with each secret in text replaced by MASK; n_chars, if there, counts the new text. Null stays null."""
    df = with_findings(docs, trees)
    rest = F.transform("__fw_found", lambda x, i: F.concat(F.when(F.round(x["probability"], 9) >= threshold, MASK).otherwise(x["candidate"]), F.get("__fw_pieces", i + 1)))
    text = F.when(F.col("text").isNotNull(), F.concat(F.get("__fw_pieces", F.lit(0)), F.array_join(rest, "")))
    df = df.withColumn("text", F.when(F.size("__fw_found") > 0, text).otherwise(F.col("text"))).drop("__fw_pieces", "__fw_found")
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
