"""Licence scans with DataFrame operations only: a trained paragraph classifier, confirmed by templates.

A paragraph is a window of WINDOW words, every half window one, so a notice is seen whole however it
is wrapped over lines; blank lines separate. Word 1- to 3-grams are hashed, and a multinomial
logistic regression with an L1 penalty, trained here, gives the few of them a weight that tell
families apart; a paragraph's score is the sum over its grams, by a join with that small table. All
paragraphs of all texts are scored: one without any such gram has the score of the intercept.

Training rows are notices, declarations by name, denials and near misses (licence_texts), amid words
of the corpus, against paragraphs of a bounded sample of it. The margin over "unknown" is turned into
a probability by a second regression on labelled rows that the first has not seen, and paragraphs
below LEAST stay unknown. A template of the predicted family, a notice or a name, must then share
CONFIRM of its grams with the paragraph: names of licences whose text isn't there are no prediction,
and templates alone would take denials for declarations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbsense.llm.columns import has_word, let, running, text_key
from curbsense.llm.licence_texts import DECLARED, DENIALS, FRAMES, NEAR_MISSES, NOTICES
from curbsense.llm.session import staged

UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
#: Words of a paragraph; paragraphs begin every half of it.
WINDOW = 64
#: Families by number in groups of variants of one another.
KINDRED = [[FAMILIES.index(f) for f in g] for g in [["GPL", "GPL-2.0", "GPL-3.0", "LGPL", "AGPL-3.0"], ["BSD-2-Clause", "BSD-3-Clause"], [f for f in FAMILIES if f.startswith("CC")]]]
KINDRED += [[i] for i in range(1, len(FAMILIES)) if not any(i in g for g in KINDRED)]
#: Texts of the corpus in the training and calibration sample, at most, and paragraphs taken of each; the only part that doesn't use all rows.
SAMPLE, OF_EACH = 1500, 2
#: What a row of the sample counts in training; there are many more such rows than of any family.
CORPUS_WEIGHT = 0.3
#: Least calibrated probability of a paragraph's best prediction, and of further ones, and the share of a template's grams that confirms one.
LEAST, FURTHER, CONFIRM = 0.5, 0.95, 0.7
#: Most texts with predictions whose keys and paragraphs may be broadcast; beyond, they are joined by shuffle.
BROADCAST_TEXTS = 200_000
#: Stands between words for a blank line.
GAP = "¶"


def token_lines(text: Column) -> Column:
    """For each line its words: lower case, letters, digits and inner dots; a line without any is a gap."""
    plain = F.regexp_replace(F.lower(text), r"(?:[\x00-\x09\x0b-\x2d\x2f\x3a-\x60\x7b-\x7f‐-‧]|\.(?![0-9]))+", " ")
    return F.transform(F.split(plain, "\n"), lambda x: let(F.array_remove(F.split(x, " "), ""), lambda w: F.when(F.size(w) == 0, F.array(F.lit(GAP))).otherwise(w)))


def grams(tokens: Column) -> Column:
    """Three hashes a word: of the word, and of the two and three words that begin with it; fewer at the end, where the shorter ones repeat."""
    at = lambda i: F.get(tokens, i)
    return F.flatten(F.transform(tokens, lambda w, i: F.array(F.xxhash64(w), F.xxhash64(w, at(i + 1)), F.xxhash64(w, at(i + 1), at(i + 2)))))


def _grams_of(text: Column) -> Column:
    return let(F.flatten(token_lines(text)), grams)


@dataclass
class Classifier:
    #: Rows (gram, number, weights): what a gram adds to the score of each family.
    weights: DataFrame
    intercepts: list[float]
    #: Probability of a margin m over "unknown": 1 / (1 + exp(-(slope * m + offset))).
    slope: float
    offset: float
    #: Rows (label, of): distinct grams of each template.
    templates: DataFrame


def labelled(spark: SparkSession) -> DataFrame:
    """Rows (label, text, template) of licence_texts."""
    rows = [(FAMILIES.index(f), t, True) for f, texts in NOTICES.items() for t in texts]
    for f, texts in NOTICES.items():
        # Parts of long notices, as a window may hold them; the licences of one family of texts differ only in some of theirs.
        parts = [t.split() for t in texts if "GPL" not in f]
        rows += [(FAMILIES.index(f), " ".join(w[i : i + 24]), False) for w in parts for i in range(0, max(0, len(w) - 20), 12)]
    for f, names in DECLARED.items():
        rows += [(FAMILIES.index(f), n, n not in ("MIT", "ISC")) for n in names]
        # Every frame meets some of a family's names, and every name some of the frames.
        rows += [(FAMILIES.index(f), s.format(n), False) for k, n in enumerate(names) for i, s in enumerate(FRAMES) if i < 9 or (i + k) % 4 == 0]
        rows += [(0, s.format(n), False) for k, n in enumerate(names) for i, s in enumerate(DENIALS) if (i + k) % 4 == 0]
    rows += [(0, t, False) for t in NEAR_MISSES]
    return spark.createDataFrame(rows, "label int, text string, template boolean").coalesce(4)


def train(spark: SparkSession, sample: DataFrame) -> Classifier:
    """The classifier from a bounded sample of paragraphs (text, none repeated)."""
    given = labelled(spark)
    templates = staged(given.where("template").select("label", F.array_distinct(_grams_of(F.col("text"))).alias("of")).distinct())
    fold = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(4))
    plain = staged(sample.select("text", fold.alias("fold")).withColumn("grams", _grams_of(F.col("text"))))
    # Sampled paragraphs that hold much of a template are no example of "unknown": they are found by their common grams.
    parts = templates.select(F.col("of").alias("id"), F.explode("of").alias("gram"), F.size("of").alias("n"))
    shared = plain.select("text", F.explode(F.array_distinct("grams")).alias("gram")).join(F.broadcast(parts), "gram").groupBy("text", "id", "n").agg(F.count(F.lit(1)).alias("common"))
    plain = plain.join(shared.where("common >= 0.5 * n").select("text").distinct(), "text", "left_anti")
    # Words that stand around a notice: of the sampled paragraphs of least hash.
    fillers = plain.where("fold = 0").select(F.xxhash64(F.lit(2), "text").alias("h"), F.array_join(F.slice(F.split("text", " "), 1, 25), " ").alias("filler")).orderBy("h", "filler").limit(60).select("filler")
    around = F.array(F.lit(""), *(F.lit(r[0]) for r in fillers.collect()))
    near = lambda side: F.get(around, F.pmod(F.xxhash64(F.lit(side), "text"), F.size(around)).cast("int"))
    amid = given.select("label", F.lit(True).alias("amid"), F.concat_ws("\n", near(4), "text", near(5)).alias("text"))
    given = given.select("label", F.lit(False).alias("amid"), "text").unionByName(amid)
    given = given.select("label", "amid", (F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(5)) == 0).alias("held"), _grams_of(F.col("text")).alias("grams"), F.lit(1.0).alias("weight"))
    rows = given.unionByName(plain.select(F.lit(0).alias("label"), F.lit(True).alias("amid"), (F.col("fold") == 3).alias("held"), "grams", F.lit(CORPUS_WEIGHT).alias("weight")))
    rows = staged(rows.withColumn("grams", F.transform(F.array_distinct("grams"), lambda g: g.cast("string"))).coalesce(4))
    # The grams of licence_texts: a fixed, small set.
    vocabulary = sorted(r[0] for r in rows.where("NOT amid AND NOT held").select(F.explode("grams")).groupBy("col").count().where("count > 1").select("col").collect())
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    rows = counts.transform(rows).select("label", "held", "weight", "features")
    model = LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", regParam=0.0001, elasticNetParam=0.5, maxIter=80, standardization=False).fit(rows.where("NOT held"))
    matrix = model.coefficientMatrix.toArray()
    used = [(int(g), k, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary) if abs(matrix[:, k]).max() > 1e-4]
    scores = model.transform(rows.where("held")).select("label", vector_to_array("rawPrediction").alias("s"))
    margin = F.array_max(F.slice("s", 2, len(FAMILIES))) - F.col("s")[0]
    right = (F.col("label") > 0) & (F.array_position("s", F.array_max("s")) == F.col("label") + 1)
    held = VectorAssembler(inputCols=["m"], outputCol="x").transform(scores.select(margin.alias("m"), right.cast("double").alias("right")))
    fit = LogisticRegression(featuresCol="x", labelCol="right", regParam=0.001, maxIter=50).fit(held)
    weights = staged(spark.createDataFrame(used, "gram long, number int, weights array<double>").coalesce(1))
    return Classifier(weights, [float(x) for x in model.interceptVector], float(fit.coefficients[0]), float(fit.intercept), templates)


def _windows(text: Column) -> Column:
    """The words of each window of a text, as texts."""
    return let(F.flatten(token_lines(text)), lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / (WINDOW // 2)).cast("int")), lambda w: F.array_join(F.slice(t, w * (WINDOW // 2) + 1, WINDOW), " ")))


def sampled(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """Paragraphs (text) of at most `size` texts, those of least hash: the same in every run and whatever the order of rows."""
    texts = df.where(has_word(F.col(text_col))).select(F.xxhash64(F.lit(7), text_col).alias("h"), F.col(text_col).alias("whole"))
    last = texts.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    some = texts.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"])
    # Of each text the windows of least hash.
    least = F.slice(F.sort_array(F.transform(_windows(F.col("whole")), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, OF_EACH)
    return staged(some.select(F.explode(least).alias("w")).select(F.col("w.x").alias("text")).distinct())


def predicted(rows: DataFrame, of: Classifier) -> DataFrame:
    """Rows (key, window, label, p) of paragraphs of rows (key, whole) that are likely to declare a licence."""
    # A row's grams are counted apart from those of equal texts, which give equal predictions.
    words = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "key", F.posexplode(_grams_of(F.col("whole"))).alias("pos", "gram"))
    hits = words.join(F.broadcast(of.weights.select("gram", "number")), "gram")
    # What crosses the network is one row a text, with two numbers for each gram that counts; all that follows stays where it is.
    at = F.floor(F.col("pos") / (3 * (WINDOW // 2))).cast("int")
    hits = hits.groupBy("row", "key").agg(F.collect_list(F.struct(at.alias("at"), "number")).alias("hits")).select("row", "key", F.explode("hits").alias("h"))
    hits = hits.select("row", "key", "h.number", F.explode(F.array("h.at", F.col("h.at") - 1)).alias("window")).where("window >= 0")
    # In a window a gram counts once.
    seen = hits.dropDuplicates(["row", "key", "window", "number"]).join(F.broadcast(of.weights.select("number", "weights")), "number")
    sums = seen.groupBy("row", "key", "window").agg(*(F.sum(F.col("weights")[f]).alias(f"s{f}") for f in range(len(FAMILIES))))
    score = [F.col(f"s{f}") + of.intercepts[f] for f in range(len(FAMILIES))]
    # A paragraph may declare several licences, but of variants of one only that with the best score.
    best = [F.array_max(F.array(*(F.struct(score[f].alias("s"), F.lit(f).alias("label")) for f in group))) for group in KINDRED]
    out = sums.select("key", "window", score[0].alias("s0"), F.array(*best).alias("best")).select("key", "window", "s0", F.array_max("best").alias("top"), F.explode("best").alias("best"))
    p = 1 / (1 + F.exp(-(of.slope * (F.col("best.s") - F.col("s0")) + of.offset)))
    out = out.withColumn("p", p).where(F.col("p") >= F.when(F.col("best.label") == F.col("top.label"), LEAST).otherwise(FURTHER))
    return out.select("key", "window", "best.label", "p").dropDuplicates(["key", "window", "label"])


def confirmed(rows: DataFrame, guesses: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows (key, family, paragraphs) of guesses that a template confirms: for each family the first lines of its notices.

    Only texts with a guess are read again. Overlapping windows of one notice count once.
    """
    wanted = staged(guesses.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("window", "label"))).alias("guesses")))
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "key").dropDuplicates(["key"])
    lines = texts.select("key", "guesses", token_lines(F.col("whole")).alias("lines"), F.transform(F.split("whole", "\n"), has_word).alias("worded"))
    lines = lines.select("key", "guesses", F.flatten("lines").alias("tokens"), running(F.transform("lines", lambda x: F.size(x)), lambda a, b: a + b).alias("starts"), running(F.transform("worded", lambda x: x.cast("int")), lambda a, b: a + b).alias("before"))
    each = lines.select("key", "tokens", "starts", "before", F.explode("guesses").alias("g"))
    first = F.col("g.window") * (WINDOW // 2)
    each = each.select("key", "g.window", "g.label", "starts", "before", first.alias("first"), let(F.slice("tokens", first + 1, WINDOW), grams).alias("own"))
    near = each.join(F.broadcast(templates), "label").where(F.size(F.array_intersect("own", "of")) >= CONFIRM * F.size("of"))
    # The longest template that fits tells where the notice begins.
    near = near.groupBy("key", "window", "label", "first").agg(F.max_by(F.struct("own", "of", "starts", "before"), F.size("of")).alias("n"))
    # It begins with the first three words in common, or where there are none with two, or one.
    at = [F.nullif(F.array_position(F.transform("n.own", lambda g, i: (i % 3 == k) & F.array_contains("n.of", g)), F.lit(True)), F.lit(0)) for k in (2, 1, 0)]
    start = F.col("first") + F.floor((F.coalesce(*at) - 1) / 3).cast("int")
    line = F.size(F.filter("n.starts", lambda s: s <= start)) - 1
    found = near.select("key", "label", "window", F.get("n.before", line).alias("paragraph"))
    runs = found.groupBy("key", "label").agg(F.sort_array(F.collect_list(F.struct("window", "paragraph"))).alias("runs"))
    heads = F.filter(F.col("runs"), lambda r, i: (i == 0) | (r["window"] > F.get("runs", i - 1)["window"] + 1))
    return runs.select("key", F.get(F.array(*map(F.lit, FAMILIES)), F.col("label")).alias("family"), F.transform(heads, lambda r: r["paragraph"]).alias("paragraphs"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of df: id, n_paragraphs, n_licences (notices that declare one), licences and first_paragraph.

    n_paragraphs are the lines with a word. licences lists the families found, in order of name,
    joined by commas; a family without a version or variant goes where the text also names one of
    them (GPL beside GPL-3.0). first_paragraph is the number (from 0, among lines with a word) of
    the line in which the first notice begins, null where there is none. A null, empty or blank text
    has no paragraph. A null id stays null; repeated rows give equal rows; an empty table gives
    none. Texts of any length are read whole; other columns of df are left out and may have any name.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("whole")).withColumn("key", text_key(F.col("whole")))
    of = train(spark, sampled(rows, "whole", sample))
    found = confirmed(rows.select("key", "whole"), staged(predicted(rows.select("key", "whole"), of)), of.templates)
    hits = found.groupBy("key").agg(F.collect_list(F.struct("family", "paragraphs")).alias("f"))
    named = F.transform("f", lambda x: x["family"])
    hits = hits.withColumn("f", F.when(F.exists(named, lambda n: n.startswith("GPL-") | n.startswith("AGPL") | n.startswith("LGPL")), F.filter("f", lambda x: x["family"] != "GPL")).otherwise(F.col("f")))
    hits = hits.select("key", F.size(F.flatten("f.paragraphs")).cast("long").alias("n"), F.array_join(F.sort_array("f.family"), ",").alias("licences"), F.array_min(F.flatten("f.paragraphs")).alias("first_paragraph"))
    docs = rows.select("id", "key", F.size(F.filter(F.split("whole", "\n"), has_word)).cast("long").alias("n_paragraphs"))
    out = docs.join(staged(hits), "key", "left")
    return out.select(F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n", F.lit(0)).alias("n_licences"), F.coalesce("licences", F.lit("")).alias("licences"), "first_paragraph")
