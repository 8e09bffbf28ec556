"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame functions. A candidate is a value assigned to a name of a secret,
whatever its length and characters, a key with a known prefix, or a run of at least
``LEAST`` letters, digits and +/_- with a digit in it. The forest sees its length, its character classes and
the transitions between them, how much of it dictionary words cover (the corpus's own most
frequent words), the path of the document, and the words next to it. It is trained on
labelled findings; without any, on those that two plain rules agree to label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.llm.shared import fresh, stored

LEAST = 16
#: Words of the dictionary; labelled findings of each class; characters read next to a candidate.
DICTIONARY, SAMPLE, NEAR = 2000, 10_000, 80
TREES, DEPTH, SEED = 24, 6, 7
THRESHOLD = 0.5
REPLACEMENT = "<secret>"

# Words that name a secret when they stand before it, and parts of paths
# that hold examples or settings.
NAMES = ["token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "api"]
PASSWORDS = ["password", "passwd", "pwd"]
EXAMPLE_PATHS = "test|example|sample|doc|mock|lock"
SETTING_PATHS = r"conf|\.env|secret|deploy|setting"

_OPEN, _CLOSE = "\x01", "\x02"
_RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])([A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}})"
# Name and sign of an assignment, then the value: in double or single quotes, or else (also
# behind a quote that is not closed on its line) up to the next blank.
_NAMED = r"(?:token|secret|password|passwd|pwd|credentials?|bearer|api_?key|(?<![a-z])(?:key|auth|api)|(?-i:(?<=[a-z])Key))"
_ASSIGNED = rf"(?i)({_NAMED}[\"']?\s{{0,4}}(?:=>|:=|[:=]{{1,2}})\s{{0,4}})(?:(\")([^\"\r\n]+)(?=\")|(')([^'\r\n]+)(?=')|([\"']?)([^\s\"']*[^\s\"',;.)\]}}]))"
# Keys that their first characters give away.
_PREFIXED = (
    r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"
)
_TURN = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[+/_-])"

FEATURES = [
    "length", "digits", "upper", "turns", "distinct", "covered", "hex", "all_digits", "padded",
    "assigned", "quoted", "slashes", *[f"before_{n}" for n in NAMES], "near_known", "example_path", "setting_path", "known_prefix",
]


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more, counted over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    counts = words.groupBy("word").count()
    return [r.word for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def _share(candidate: Column, other: str) -> Column:
    return F.length(F.regexp_replace(candidate, other, "")) / F.length(candidate)


def _known_length(words: Column, known: list[str]) -> Column:
    if not known:
        return F.lit(0)
    return F.aggregate(words, F.lit(0), lambda total, w: total + F.when(w.isin(known), F.length(w)).otherwise(0))


def candidates(docs: DataFrame, known: list[str], key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: key, row, start, length, the candidate and its features.

    ``start`` counts characters of the original text. Null and empty texts have none.
    """
    # Marks around each candidate; the text's own such characters become blanks.
    clean = F.translate(F.col(text), _OPEN + _CLOSE, "  ")
    assigned = F.regexp_replace(clean, _ASSIGNED, f"$1$2$4$6{_OPEN}$3$5$7{_CLOSE}")
    # What is marked is passed over; the empty marks behind it go again.
    others = F.regexp_replace(assigned, f"({_OPEN}[^{_CLOSE}]*{_CLOSE})|{_PREFIXED}|{_RUN}", f"$1{_OPEN}$2$3{_CLOSE}")
    parts = F.split(F.replace(others, F.lit(_OPEN + _CLOSE), F.lit("")), _OPEN)
    row = F.monotonically_increasing_id()
    found = docs.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), row.alias("row"), parts.alias("parts")).where(F.size("parts") > 1)
    piece = found.select("key", "path", "row", F.posexplode("parts").alias("pos", "part"))
    piece = piece.select("key", "path", "row", "pos", F.length("part").alias("size"), F.substring_index("part", _CLOSE, 1).alias("candidate"), F.element_at(F.split("part", _CLOSE), -1).alias("rest"))
    piece = piece.select("key", "path", "row", "pos", "size", F.when(F.col("pos") > 0, F.col("candidate")).alias("candidate"), F.substring("rest", 1, NEAR).alias("after"), F.right("rest", F.lit(NEAR)).alias("tail"))
    in_text = Window.partitionBy("row").orderBy("pos")
    earlier = in_text.rowsBetween(Window.unboundedPreceding, -1)
    placed = piece.withColumn("before", F.lag("tail").over(in_text)).withColumn("start", F.sum("size").over(earlier) - (F.col("pos") - 1))
    placed = placed.where("candidate is not null").drop("tail", "pos", "size")

    c, before = F.col("candidate"), F.lower("before")
    neighbours = F.split(F.lower(F.concat_ws(" ", F.col("before"), F.col("after"))), r"[^a-z]+")
    words = F.filter(neighbours, lambda w: F.length(w) >= 3)
    read = F.aggregate(words, F.lit(0), lambda total, w: total + F.length(w))
    features = {
        "length": F.length(c),
        "digits": _share(c, "[^0-9]"),
        "upper": _share(c, "[^A-Z]"),
        "turns": F.regexp_count(c, F.lit(_TURN)) / F.length(c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64)),
        "covered": _known_length(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), 0), known) / F.length(c),
        "hex": c.rlike("^[0-9a-fA-F]+$"),
        "all_digits": c.rlike("^[0-9]+$"),
        "padded": c.endswith("="),
        "assigned": before.rlike(r"[:=]\s*[\"']?$"),
        "quoted": before.rlike("[\"']$"),
        "slashes": c.contains("/") | before.rlike(r"/\S*$"),
        **{f"before_{n}": F.right(before, F.lit(30)).contains(n) for n in NAMES},
        "near_known": F.when(read > 0, _known_length(words, known) / read).otherwise(0.0),
        "example_path": F.lower("path").rlike(EXAMPLE_PATHS),
        "setting_path": F.lower("path").rlike(SETTING_PATHS),
        "known_prefix": c.rlike(f"^{_PREFIXED}"),
    }
    return placed.select("key", "row", "start", F.length(c).alias("size"), "candidate", *[F.coalesce(features[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def label_by_rules(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 and 0 where the rules are sure, else null.

    Sure secrets have a known prefix, or are assigned to a name of a secret, look random
    or are named a password, and are quoted or hold a digit. Sure others are plain numbers, known words or very
    short bare values, or stand in running text without a name or an assignment and do
    not look random. What looks random there may be a key, so it gets no label.
    """
    named = reduce(lambda a, b: a | b, (F.col(f"before_{n}") > 0 for n in NAMES))
    random_looking = (F.col("all_digits") == 0) & (F.col("covered") < 0.3) & (F.col("distinct") > 0.2)
    evident = (F.col("quoted") > 0) | (F.col("digits") > 0)
    bare = ~evident & (F.col("length") < 6)
    plain = (F.col("all_digits") > 0) | (F.col("covered") > 0.6) | bare | ~named & (F.col("assigned") == 0) & ~random_looking
    password = reduce(lambda a, b: a | b, (F.col(f"before_{n}") > 0 for n in PASSWORDS))
    sure = (F.col("known_prefix") > 0) | named & (F.col("assigned") > 0) & (random_looking | password) & evident
    return found.withColumn("label", F.when(sure, 1.0).when(plain, 0.0))


def train(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """The forest from at most ``sample`` labelled findings of each class; None if one is missing."""
    drawn = [labelled.where(F.col("label") == c).orderBy(F.xxhash64("candidate", "start"), "candidate", "start", "key").limit(sample) for c in (0.0, 1.0)]
    rows = stored(drawn[0].union(drawn[1]).select("label", *FEATURES).coalesce(1), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label")
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def score(found: DataFrame, model: PipelineModel | None, *more: str) -> DataFrame:
    """Key, row, start, length, candidate and the forest's ``score``; 0 without a model."""
    kept = ("key", "row", "start", F.col("size").alias("length"), "candidate", *more)
    if model is None:
        return found.select(*kept, F.lit(0.0).alias("score"))
    return model.transform(found).select(*kept, vector_to_array("probability")[1].alias("score"))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The candidates that the forest takes for secrets, with key, row, start and length.

    The forest decides on every candidate, except that known prefixes need no vote.
    ``labelled`` has the columns of :func:`candidates` and ``label``; without it the rules
    label what they are sure of, for training only: what they take for a secret is
    dropped if the forest disagrees. Repeated rows give repeated findings. If either class
    has no labelled finding there is no model; then only keys of a known prefix are found,
    with score 0.
    """
    found = stored(candidates(docs, dictionary(docs, text), key, text, path), "candidates")
    model = train(label_by_rules(found) if labelled is None else labelled)
    return score(found, model, "known_prefix").where((F.col("known_prefix") > 0) | (F.col("score") >= threshold)).drop("known_prefix")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all rows and columns stay.

    A secret is cut out where it was found, by its offset; the same characters elsewhere
    in the text, and all others, stay as they are.
    """
    text_hash, found = fresh(docs, "_hash"), fresh(docs, "_found")
    # What is replaced depends on the text alone, so its hash joins the findings back.
    hashed = docs.withColumn(text_hash, F.xxhash64(text))
    secrets = findings(hashed, text_hash, text, path, labelled)
    span = F.struct("start", "length", F.xxhash64("candidate").alias("of"))
    per_text = secrets.groupBy(F.col("key").alias(text_hash)).agg(F.sort_array(F.collect_set(span)).alias(found))

    def cut(done, s):
        # Another text of this hash has other characters there and keeps them.
        same = F.xxhash64(F.substring(F.col(text), s["start"] + 1, s["length"])) == s["of"]
        out = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, s["start"] - done["at"]), F.lit(REPLACEMENT))
        return F.when(same, F.struct((s["start"] + s["length"]).alias("at"), out.alias("out"))).otherwise(done)

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    spans = F.transform(F.col(found), lambda s: F.struct(s["start"].cast("long").alias("start"), s["length"].cast("long").alias("length"), s["of"].alias("of")))
    without = F.aggregate(spans, begin, cut, lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text))))
    cleaned = F.when(F.col(found).isNull(), F.col(text)).otherwise(without)
    joined = hashed.join(per_text, text_hash, "left")
    return joined.select(*[cleaned.alias(c) if c.lower() == text.lower() else F.col(c) for c in docs.columns])
