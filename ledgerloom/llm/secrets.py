"""Secret scans with DataFrame functions and Spark's random forest only.

Candidates are wide: a value of at least LEAST_VALUE characters after an assignment or a key word, whatever characters it
has, up to its quote or a space; and, anywhere, runs of at least LEAST_LENGTH characters of keys and tokens, with or without
digits. A run ends at its first '=', so a key is never part of its value. The forest removes the false ones. Its features
are the candidate's length, how likely its characters follow each other in plain words (a table of transitions counted on the
words of all documents), its character classes, how much of it dictionary words cover, its path and its neighbouring words. It is
trained on labelled findings; where none are given, labelled_findings() makes a documented set by rule, and a bounded number of
plain words of the documents themselves are added as what is no secret. The trained forest is small and applied inside the JVM.
Texts are never shuffled: candidates and the counts of words are.

Defined results: null and empty texts have no findings; a null path is empty. Rows that repeat both doc_id and text give
their findings once. Offsets count code points from 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

LEAST_LENGTH = 16
LEAST_VALUE = 4
#: Words that a secret follows, also without an assignment.
KEY_WORD = r"(?:pass(?:word|wd|phrase|code|wort)?|pwd|pw|kennwort|secrets?|tokens?|credentials?|creds?|bearer|basic|auth(?:orization)?|(?:api|access|private|secret|signing|master|client)[ _.\-]?keys?)"
_RUN = r"[A-Za-z0-9+/_\-]"
_ASSIGN = r"(?:=>|:=|==|::|[=:])\s*+"
_KEYED = rf"(?<!{_RUN}){_RUN}*?(?i:{KEY_WORD})(?:[\"'`\])]{{0,2}}\s*+(?:{_ASSIGN}|>\s*+)|\s++(?:(?:is|was|are|ist|es|est)\s++)?)"
_QUOTE = r"(?:[bBrRuUfF]{0,2}\\?[\"'`])?"
#: A value without a quote ends before a next key, and before punctuation that ends it.
_PLAIN = (
    rf"(?!//|{_RUN}{{0,40}}?(?i:{KEY_WORD})(?:\s|[\"'`\])]{{0,2}}\s*[=:>]))"
    rf"(?:(?![;,&|?][\w.\-]{{1,40}}[=:])(?![,;.:)\]}}>]{{1,8}}(?:[\s\"'`]|\z))[^\s\"'`]){{{LEAST_VALUE},}}+"
)
_VALUE = "|".join([rf"(?<={q})[^\s{q}]{{{LEAST_VALUE},}}+" for q in "\"'`"] + [rf"(?<=>)[^\s<]{{{LEAST_VALUE},}}+", rf"(?<![\"'`>]){_PLAIN}"])
_BARE = rf"(?<!{_RUN})(?=[+/_\-]*+[A-Za-z0-9]){_RUN}{{{LEAST_LENGTH},}}+(?:==(?![=A-Za-z0-9\"'`])|=(?=[,;.)\]}}]|\z))?"
#: The first group is a value after a key or an assignment; without it, the whole match is the candidate.
CANDIDATE = rf"(?:{_KEYED}|{_ASSIGN}){_QUOTE}({_VALUE})|{_BARE}"
#: Characters of context on either side.
CONTEXT = 48
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 7, 11
#: Rows that labelled_findings() makes, plain words of the documents that are added to them, and the most that are trained on: the first by hash.
FINDINGS, PLAIN, TRAINED = 4000, 1000, 20_000
#: What characters are told apart as, for their transitions: lower-case letters, any digit, anything else.
LETTERS = "abcdefghijklmnopqrstuvwxyz0_"
#: Rules that labelled_findings() makes them by, dealt by number.
KINDS = 36

DICTIONARY = (
    "account after again api april auth before build cache case check class client code color config count create data date default delete demo device document domain down "
    "email empty error event example file filter first format from get group guest hello here home host image index input insert item january key last level line list local "
    "login long main make march message method model month name network null number object open order other output page parent part password path place point port private "
    "process product public query random read release report request response result return root sample search secret server service session set size source start state status "
    "string system table tag target task temp test text this time title token type update upload url user value version view week width window with word world write year your"
).split()
SYMBOLS = ("!", "#", "$", "&", "@", "%", "?", "*", "^", "~")
FAVOURING = "token|secret|passw|pwd|credential|bearer|auth|api.?key|access.?key|private.?key|signing"
OPPOSING = "commit|revision|checksum|digest|sha-?1|sha-?256|md5|hash|uuid|guid|invoice|order|phone|card|iban|build|serial|trace|etag|version"


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), "[^a-z0]", "_")


def prose(documents: DataFrame) -> DataFrame:
    """word and n: how often each run of letters of 2 characters or more is in documents(text), lower-cased; counted over all of them, with partial sums."""
    words = F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")
    return documents.select(F.explode(words).alias("word")).where("length(word) > 1").groupBy("word").agg(F.count("*").alias("n"))


def transitions(words: DataFrame) -> dict[str, float]:
    """log P(next | character) over LETTERS in words(word, n)."""
    texts = words.where("length(word) > 1").select(_letters(F.col("word")).alias("t"), "n")
    pairs = texts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substr(F.col("t"), i, F.lit(2)))).alias("pair"), "n")
    counts = {r["pair"]: r["n"] + 0.5 for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most 784
    total = {a: sum(counts.get(a + b, 0.5) for b in LETTERS) for a in LETTERS}
    return {a + b: math.log(counts.get(a + b, 0.5) / total[a]) for a in LETTERS for b in LETTERS}


def features(df: DataFrame, table: dict[str, float]) -> DataFrame:
    """df(candidate, before, after, path) with the feature columns. table: transitions()."""
    df = df.withColumn("_walk", F.transform(F.split(_letters(F.col("candidate")), ""), lambda x: F.instr(F.lit(LETTERS), x)))
    # the table as one text, tenths as characters: an array of 784 numbers would be written out in the generated code
    of_pair, walk = F.lit("".join(chr(33 + min(93, round(-10 * table[a + b]))) for a in LETTERS for b in LETTERS)), F.col("_walk")
    steps = F.zip_with(F.slice(walk, 1, F.size(walk) - 1), F.slice(walk, 2, F.size(walk)), lambda a, b: (33 - F.ascii(F.substr(of_pair, (a - 1) * len(LETTERS) + b, F.lit(1)))) / F.lit(10.0))
    df = df.withColumn("_steps", F.array_compact(steps)).drop("_walk")
    taken = F.greatest(F.size("_steps"), F.lit(1))
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    uncovered = F.length(F.regexp_replace(F.lower(c), words, ""))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    flag = lambda text, pattern: F.coalesce(text.rlike(pattern), F.lit(False)).cast("double")
    own = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "vowels": share("[AEIOUaeiou]"),
        "hex": share("[0-9a-fA-F]"),
        "separators": share(r"[_=/+\-]"),
        "transitions": F.aggregate("_steps", F.lit(0.0), lambda acc, x: acc + x) / taken,
        "rare_transitions": F.size(F.filter("_steps", lambda x: x < math.log(0.01))) / taken,
        "class_changes": share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_=/+\-])(?=[A-Za-z0-9])"),
        "repeats": share(r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": (n - uncovered) / n,
        "segments": (F.regexp_count(c, F.lit("/")) + F.regexp_count(F.coalesce("path", F.lit("")), F.lit("/"))).cast("double"),
        "path_of_tests": flag(F.lower("path"), "test|example|sample|fixture|mock|docs?/|spec"),
        "symbols": share(r"[^A-Za-z0-9]"),
        "classes": sum(c.rlike(k).cast("double") for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        "word": flag(c, r"^\p{L}\p{Ll}*$"),
        "clusters": share("(?i)[bcdfghjklmnpqrstvwxz]{4,}"),
        "placeholder": flag(c, r"^[<$%{(\[*.]|[(\[{]|^(.)\1+$"),
        "keyed": flag(F.col("before"), rf"(?i){KEY_WORD}[\w\-]*[\"'`\])]{{0,2}}\s*(=>|:=|==|[=:>])\s*[bruf]{{0,2}}\\?[\"'`]?$"),
        "follows_key_word": flag(F.col("before"), rf"(?i){KEY_WORD}\s+((is|was|are|ist|es|est)\s+)?[\"'`]?$"),
        "names": flag(F.col("after"), r"""^["'`\])]{0,2}\s*[=:]"""),
        "assigned": flag(F.col("before"), r"""[=:]\s*["'`]?$"""),
        "quoted": flag(F.col("before"), r"""["'`]$"""),
        "favouring": flag(near, FAVOURING),
        "opposing": flag(near, OPPOSING),
    }
    return df.withColumns({f"f_{k}": v.cast("double") for k, v in own.items()}).drop("_steps")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Findings of known kind, made by rule from hashes of their numbers: candidate, before, after, path, is_secret."""
    ids = spark.range(n).select("id", (F.col("id") % KINDS).alias("kind"), F.sha2(F.col("id").cast("string"), 512).alias("h"), F.md5(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("m"))
    at = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (F.conv(F.substring("m", k, 3), 16, 10).cast("int") % len(of) + 1).cast("int"))
    length = 20 + F.conv(F.substring("m", 1, 2), 16, 10).cast("int") % 45
    base64 = F.regexp_replace(F.base64(F.unhex("h")), "=+$", "")
    sized = lambda x: F.substr(x, F.lit(1), length.cast("int"))
    word = lambda k: at(k, DICTIONARY)
    digits = F.regexp_replace(F.concat("h", "m"), "[a-f]", "")
    secret_word, other_word = ("token", "secret", "api_key", "password", "auth_token", "access-key", "Bearer", "client secret"), ("commit", "sha1", "md5 checksum", "build", "trace", "etag", "revision", "uuid")
    plain = F.concat_ws(" ", word(4), word(7))
    key = lambda k: at(k, ("password", "passwd", "pwd", "pw", "db password", "DB_PASSWORD", "secret", "token", "api_key", "auth token", "credential", "passphrase"))
    assign = at(13, (' = "', ": ", "=", "='", '": "', " = ", ':"', "> "))
    some = lambda a, n: F.substr(digits, a, F.lit(n))
    letters = lambda a, n: F.substr(F.regexp_replace(F.concat(base64, F.base64(F.unhex(F.sha2("m", 512)))), "[0-9+/=]", ""), F.lit(a), F.lit(n))
    mixed = lambda x: F.translate(x, "oeai", "03@1")
    syllables = lambda k: F.concat(at(k, ("ba", "lo", "mi", "ter", "gen", "sch", "con", "é", "ra", "ver", "ü", "pre")), at(k + 1, ("no", "si", "lich", "men", "ta", "der", "os", "que", "ren", "al")))
    kinds: list[tuple[Column, Column, int]] = [
        (F.substr("h", F.lit(1), F.lit(40)), F.concat(plain, F.lit(" "), at(10, secret_word), at(12, (' = "', ": ", "=", "='"))), 1),
        (sized(base64), F.concat(plain, F.lit(" "), at(10, secret_word), at(12, (' = "', ": ", "=", "='"))), 1),
        (F.concat(at(14, ("ghp_", "sk_live_", "xoxb-", "AKIA", "glpat-")), sized(F.regexp_replace(base64, "[+/]", "x"))), F.concat(plain, at(12, (' = "', ": ", " ", '"'))), 1),
        (F.substr("h", F.lit(1), F.lit(32)), F.concat(at(10, secret_word), at(12, (' = "', ": ", "=", "='"))), 1),
        (F.upper(F.substr("h", F.lit(1), F.lit(40))), F.concat(F.upper(at(10, secret_word)), at(12, (' = "', " = "))), 1),
        (sized(F.concat("m", "h")), F.concat(plain, F.lit(" "), at(10, secret_word), F.lit(' = "')), 1),
        (F.substr(digits, F.lit(1), F.lit(16)), plain, 0),
        (F.substr("h", F.lit(1), F.lit(40)), F.concat(plain, F.lit(" "), at(10, other_word), at(12, (" ", ": ", " = "))), 0),
        (F.concat_ws("-", word(1), word(4), word(7), F.substr(digits, F.lit(1), F.lit(3))), plain, 0),
        (F.concat_ws("/", word(1), word(4), F.concat(word(7), F.substr(digits, F.lit(1), F.lit(2))), word(9)), plain, 0),
        (F.concat(F.repeat(at(14, ("x", "0", "-", "=", "1")), length.cast("int")), F.lit("1")), F.concat(at(10, secret_word), F.lit(' = "')), 0),
        (F.upper(F.concat_ws("_", F.lit("your"), word(1), word(4), F.lit("here1"))), F.concat(at(10, secret_word), F.lit('="')), 0),
        (F.concat_ws("-", *(F.substr("h", F.lit(a), F.lit(b)) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.concat(plain, at(10, (" id ", " uuid ", " ", " guid: "))), 0),
        (F.concat(word(1), word(4), word(7), F.substr(digits, F.lit(1), F.lit(4))), plain, 0),
        (F.concat(F.lit("20"), F.substr(digits, F.lit(1), F.lit(2)), F.lit("-01-"), F.substr(digits, F.lit(3), F.lit(2)), F.lit("T"), F.substr(digits, F.lit(5), F.lit(6))), plain, 0),
        (F.concat(F.repeat(word(1), 3), F.substr(digits, F.lit(1), F.lit(1))), F.concat(plain, F.lit(" = ")), 0),
        (F.concat(F.initcap(mixed(word(1))), some(F.lit(1), 2)), F.concat(plain, F.lit(" "), key(10), assign), 1),
        (F.concat(word(1), some(F.lit(1), 1), letters(5, 1), some(F.lit(4), 2)), F.concat(plain, F.lit(" "), key(10), assign), 1),
        (F.concat(F.initcap(mixed(word(1))), at(6, SYMBOLS), word(4), at(9, SYMBOLS), some(F.lit(1), 4)), F.concat(key(10), assign), 1),
        (letters(1, 8), F.concat(plain, F.lit(" "), key(10), assign), 1),
        (letters(1, 28), F.concat(plain, at(12, (" ", ' "', ": ", " = "))), 1),
        (F.lower(letters(1, 24)), F.concat(plain, F.lit(" "), key(10), assign), 1),
        (F.concat(F.substr(base64, F.lit(1), F.lit(5)), at(6, SYMBOLS), F.substr(base64, F.lit(9), F.lit(4)), at(9, SYMBOLS)), F.concat(key(10), assign), 1),
        (F.concat(word(1), some(F.lit(1), 3)), F.concat(key(10), at(12, (" is ", " ", " was ", ' "'))), 1),
        (F.substr("h", F.lit(1), F.lit(12)), F.concat(key(10), assign), 1),
        (F.concat(mixed(word(1)), at(6, SYMBOLS), some(F.lit(1), 2)), F.concat(F.upper(F.concat_ws("_", word(4), key(10))), F.lit("=")), 1),
        (word(1), F.concat(plain, at(12, (": ", " = ", ":", '="'))), 0),
        (word(1), F.concat(word(4), F.lit(" "), key(10), at(12, (" ", " is ", ": ", " = "))), 0),
        (F.concat(word(1), word(4), at(7, ("e", "en", "ung", "tion", "s"))), F.concat(plain, at(12, (" ", ": ", " "))), 0),
        (F.concat(syllables(1), syllables(4), syllables(7)), F.concat(F.initcap(word(4)), at(12, (": ", " ", ":\n"))), 0),
        (F.concat(syllables(1), syllables(4)), F.concat(key(10), at(12, (" ", " is ", ": ", " "))), 0),
        (F.concat(some(F.lit(1), 1), at(4, (".", ":", ",", "-")), some(F.lit(2), 2), at(5, (".", ":", "-")), some(F.lit(4), 2)), F.concat(plain, at(12, (": ", "=", " = "))), 0),
        (at(4, ("${DB_PASSWORD}", "<password>", "********", "os.environ[", "getpass.getpass()", "xxxxxxxx", "None", "null", "{{ secret }}", "[REDACTED]", "$TOKEN", "config.get(", "%(token)s", "undefined")), F.concat(key(10), assign), 0),
        (F.concat(at(4, ("//", "/", "./", "www.", "")), word(1), F.lit("."), word(4), at(7, ("/", ".com/", ".org", ".txt", "@mail.com")), word(9)), F.concat(plain, at(12, (": ", "=", ":"))), 0),
        (F.upper(F.concat_ws("_", word(4), key(10), word(1))), plain, 0),
        (F.concat(at(4, ("f", "self.", "get_", "")), word(1), at(7, ("(", "()", ".", "_")), word(9), at(12, (")", "", ");", "_id"))), F.concat(plain, F.lit(" = ")), 0),
    ]
    pick = lambda k: F.element_at(F.array(*(x[k] if isinstance(x[k], Column) else F.lit(x[k]) for x in kinds)), (F.col("kind") + 1).cast("int"))
    found = ids.select(pick(0).alias("candidate"), pick(1).alias("before"), F.when(F.col("kind") == KINDS - 2, F.lit(" = 1")).otherwise(at(18, ('"', " and then", "", "'; next"))).alias("after"), at(20, ("", "src/main/config", "lib/client", "docs/guide", "conf/.env", "notes.txt")).alias("path"), pick(2).alias("is_secret"))
    return sh.written(found, "made").where(f"length(candidate) >= {LEAST_VALUE}")  # a filter over all rules at once would not compile


@dataclass(frozen=True)
class Forest:
    table: dict[str, float]
    model: PipelineModel

    def scored(self, found: DataFrame) -> DataFrame:
        """found(candidate, before, after, path) with score, the share of the trees' votes for a secret."""
        return self.model.transform(sh.written(features(found, self.table), "features")).withColumn("score", F.round(vector_to_array("probability")[1], 9))


def plain_words(found: DataFrame, n: int = PLAIN) -> DataFrame:
    """Findings that are no secrets: candidates of small letters only, but for the first, that no key and no assignment is before; the first n by hash."""
    beside = F.col("before").rlike(r"""[=:>"'`]\s*$""") | F.col("before").rlike(rf"(?i){KEY_WORD}\W*(?:(?:is|was|are|ist|es|est)\s+)?$")
    own = found.where(F.col("candidate").rlike(r"^\p{L}\p{Ll}*$") & ~beside).select("candidate", "before", "after", "path", F.lit(0).alias("is_secret")).distinct()
    return own.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after", "path").limit(n)


def fit(labelled: DataFrame, words: DataFrame | None = None, rows: int = TRAINED) -> Forest:
    """A forest from labelled(candidate, before, after, path, is_secret): at most so many rows, the first by hash, through one task, for one result everywhere.

    words: what is known of plain text, prose(); without it, the false candidates and the words before all candidates.
    """
    given = sh.typed(labelled, candidate="string", before="string", after="string", path="string", is_secret="double").where("length(candidate) > 0 and is_secret is not null").fillna("", ["before", "after", "path"])
    own = sh.written(given.orderBy(F.xxhash64(*given.columns), *given.columns).limit(rows), "findings")
    if words is None:
        texts = own.select(F.explode(F.array(F.when(F.col("is_secret") == 0, F.col("candidate")), F.col("before"))).alias("t"))
        words = texts.select(F.explode(F.split(F.lower("t"), r"\s+")).alias("word"), F.lit(1).alias("n"))
    table = transitions(words)
    known = sh.written(features(own, table), "known")
    inputs = [c for c in known.columns if c.startswith("f_")]
    forest = RandomForestClassifier(featuresCol="features", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    return Forest(table, Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), forest]).fit(known.coalesce(1)))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, number, gap (code points since the candidate before), candidate, before, after and path."""
    docs = sh.typed(documents, doc_id="long", text="string", path="string").select("doc_id", "path", "text", F.xxhash64("text").alias("text_hash"))
    matches = [F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(k)).alias(name) for k, name in enumerate(("whole", "value"))]
    found = docs.select("doc_id", "text_hash", "path", *matches, F.split("text", CANDIDATE, -1).alias("gaps")).where(F.size("whole") > 0)
    own = lambda whole, value, gap: F.struct(
        F.when(value == "", whole).otherwise(value).alias("candidate"),
        F.when(value == "", gap).otherwise(F.concat(gap, F.left(whole, F.length(whole) - F.length(value)))).alias("left"),
    )
    each = found.select("doc_id", "text_hash", "path", F.transform(F.arrays_zip("whole", "value", F.slice("gaps", 1, F.size("whole")).alias("gap")), lambda x: own(x["whole"], x["value"], x["gap"])).alias("c"), F.element_at("gaps", -1).alias("rest"))
    # A candidate's context goes on beyond the candidates beside it, so that it holds their key.
    side = F.struct(F.lit("").alias("candidate"), F.lit("").alias("left"))
    end = F.struct(F.lit("").alias("candidate"), F.col("rest").alias("left"))
    n = F.size("c")
    three = F.arrays_zip(F.col("c").alias("own"), F.concat(F.array(side), F.slice("c", 1, n - 1)).alias("last"), F.concat(F.slice("c", 2, n), F.array(end)).alias("next"), F.slice(F.concat(F.slice("c", 2, n), F.array(end, side)), 2, n).alias("then"))
    cut = F.transform(
        three,
        lambda x: F.struct(
            x["own"]["candidate"].alias("candidate"),
            F.length(x["own"]["left"]).alias("gap"),
            F.right(F.concat(F.right(x["last"]["left"], F.lit(CONTEXT)), x["last"]["candidate"], x["own"]["left"]), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(x["next"]["left"], x["next"]["candidate"], F.left(x["then"]["left"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("after"),
        ),
    )
    return each.select("doc_id", "text_hash", "path", F.posexplode(cut).alias("number", "c")).select("doc_id", "text_hash", "number", "path", "c.*")


def scan(documents: DataFrame, labelled: DataFrame | None = None, path: str = "path") -> DataFrame:
    """doc_id, text_hash, start, length, candidate, score and is_secret of every candidate of documents(doc_id, text and the path column)."""
    spark = documents.sparkSession
    # a table of its own: patterns over whole texts, features and trees are too much for one generated class
    found = sh.written(candidates(documents.select("doc_id", "text", F.col(path).alias("path"))).dropDuplicates(["doc_id", "text_hash", "number"]), "candidates")
    words = sh.written(prose(documents.select("text")), "words")
    if labelled is None:
        labelled = labelled_findings(spark).unionByName(plain_words(found))
    scored = fit(labelled, words).scored(found)
    before = Window.partitionBy("doc_id", "text_hash").orderBy("number")  # the candidates of one document
    start = F.sum(F.col("gap") + F.length("candidate")).over(before) - F.length("candidate")
    return scored.select("doc_id", "text_hash", start.alias("start"), F.length("candidate").cast("long").alias("length"), "candidate", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redact(documents: DataFrame, labelled: DataFrame | None = None, path: str = "path", mark: str = "[secret]") -> DataFrame:
    """documents with each secret in text replaced by mark."""
    found = scan(documents, labelled, path).where("is_secret")
    spans = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_spans"))
    hit = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    joined = documents.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")), "left")
    text = F.col("text").cast("string")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct((s["start"] + s["length"]).alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"))
    cut = F.aggregate("_spans", first, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    return joined.select(*(F.when(F.col("_spans").isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(c) for c in documents.columns))
