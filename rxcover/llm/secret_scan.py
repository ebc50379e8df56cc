"""Secret candidates in texts, with a random forest that removes false positives.

DataFrame functions and Spark's own random forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcover.llm.shared import stored

# End of a name whose value is a candidate, however short.
NAME = r"(?:(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key)|(?<![A-Za-z])(?i:key)|(?<=[a-z0-9])Key)s?"
_ASSIGN = r"[\"']?[ \t]*+(?::=|=>|[:=]{1,2})[ \t]*+"
# A value in quotes, or up to white space and without closing punctuation.
_VALUE = r"(?:\"[^\"\n]++\"|'[^'\n]++'|[^\s\"']*[^\s\"',;.)\]}])"
# A run of these characters, not part of a longer word and not such a name itself.
_RUN = (
    r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{16,}+"
    r"(?!(?<=(?i:password|passwd|passphrase|pwd|secret|token|key)s?)[\"']?[ \t]*+[:=])={0,2}(?![\p{L}\p{N}])"
)
# The user and password of an address.
_ADDRESS = r"://[^\s/@:]*+:[^\s/@]++@"
# What holds a candidate. Nothing in it is tried again from a later start over the same long stretch,
# so a text takes time in proportion to its length.
CANDIDATE = f"{NAME}{_ASSIGN}{_VALUE}|{_ADDRESS}|{_RUN}"
# The candidate within what was found; the last character is not part of one that a quote or @ closes.
_WITHIN = r"^(?:(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api[_-]?)?key)s?" + _ASSIGN + r"[\"']?|://[^:]*:)"
# Places of a text that are added up at a time.
BLOCK = 256
# Characters of context on either side.
CONTEXT = 64
# Words of the corpus that form the dictionary: at least so many uses.
MIN_USES = 20
# Labelled findings of each class that training uses at most.
SAMPLE_PER_CLASS = 20_000
# Neighbouring words whose record among labelled findings is kept: the most frequent ones.
NEIGHBOURS = 1000
# Parts of the labelled findings, each described by records of the others.
FOLDS = 5
TREES = 20
DEPTH = 6
SEED = 11

FEATURES = [
    "length",
    "digits",
    "capitals",
    "class_changes",
    "variety",
    "marks",
    "transition",
    "coverage",
    "path",
    "assigned",
    "previous_record",
    "next_record",
]


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` worked out once, however often a lambda in it asks for it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def candidates(docs: DataFrame) -> DataFrame:
    """`doc_id`, `start` (code points before it), `candidate`, `before`, `after` for every candidate of every text.

    Candidates are the values given to names of passwords, secrets, tokens and
    keys (in quotes or up to white space, of any length and characters), the
    passwords of addresses, and other unbroken runs of 16 or more of
    `[A-Za-z0-9+/_-]`. Nulls and empty texts have none. Only candidates and their
    context, up to the next candidate, leave the row. Time and memory grow in
    proportion to a text's length: places are added up block by block.
    """
    text = F.col("text")
    cut = docs.filter(text.rlike(CANDIDATE)).select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"),
        F.split(text, CANDIDATE, -1).alias("gaps"),
    )
    running = "(a, x) -> concat(a, array(a[size(a) - 1] + x))"
    block = f"slice(steps, k * {BLOCK} + 1, {BLOCK})"
    listed = _let("f", "found", _let("g", "gaps", _let(
        "steps", "transform(f, (c, i) -> cast(length(g[i]) + length(c) AS bigint))", _let(
        "sums", f"transform(sequence(0, (size(f) - 1) div {BLOCK}), k -> aggregate({block}, 0L, (a, x) -> a + x))", _let(
        "heads", f"aggregate(sums, array(0L), {running})", _let(
        "places", f"flatten(transform(sums, (s, k) -> slice(aggregate({block}, array(heads[k]), {running}), 1, {BLOCK})))",
        f"""transform(f, (c, i) -> named_struct(
              'place', places[i] + length(g[i]),
              'match', c,
              'left', right(g[i], {CONTEXT}),
              'right', left(g[i + 1], {CONTEXT})))"""))))))  # fmt: skip
    # The outer form, as for the inner one the optimizer would work the list out once more to see if it is empty.
    rows = cut.selectExpr("doc_id", f"inline_outer({listed})").filter("match IS NOT NULL")
    rows = rows.withColumn("head", F.regexp_extract("match", _WITHIN, 0))
    closed = F.col("head").rlike(r"[\"']$|^://").cast("int")
    rows = rows.withColumn(
        "candidate", F.expr("substring(match, length(head) + 1)").substr(F.lit(1), F.expr("length(match) - length(head)") - closed)
    )
    return rows.select(
        "doc_id",
        (F.col("place") + F.length("head")).alias("start"),
        "candidate",
        F.expr(f"right(concat(left, head), {CONTEXT})").alias("before"),
        F.expr(f"left(concat(substring(match, length(head) + length(candidate) + 1), right), {CONTEXT})").alias("after"),
    )


def _pieces(column: str, n: int) -> Column:
    """All stretches of `n` characters, in one pass over the value."""
    return F.regexp_extract_all(column, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def dictionary(docs: DataFrame, min_uses: int = MIN_USES) -> tuple[DataFrame, DataFrame]:
    """Letter triples of the corpus's words, and the log-probability of each letter after another.

    Words are runs of a-z, in all texts; frequent words are combined before the
    shuffle. There are at most 26 ** 3 triples and 26 ** 2 pairs, whatever the corpus.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    uses = words.filter("length(word) >= 2").groupBy("word").agg(F.count("*").alias("uses"))
    uses = stored(uses.filter(F.col("uses") >= min_uses), "words")
    triples = (
        uses.filter("length(word) >= 3")
        .select(F.explode(_pieces("word", 3)).alias("triple"))
        .distinct()
    )
    pairs = uses.select("uses", F.explode(_pieces("word", 2)).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("uses").alias("n"))
    heads = pairs.groupBy(F.substring("pair", 1, 1).alias("head")).agg(F.sum("n").alias("all"))
    logs = pairs.join(F.broadcast(heads), F.substring("pair", 1, 1) == F.col("head")).select(
        "pair", F.log((F.col("n") + 1) / (F.col("all") + 26)).alias("log")
    )
    return stored(triples, "triples"), stored(logs, "pairs")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def described(found: DataFrame, triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates with what the forest sees, but for the records of neighbouring words."""
    shaped = found.withColumns(
        {
            "length": F.length("candidate").cast("double"),
            "digits": _share("[0-9]"),
            "capitals": _share("[A-Z]"),
            "class_changes": _share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
            "variety": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
            "marks": _share("[^A-Za-z0-9]"),
            # Part of a path or address: a slash inside, or one or a dot beside it.
            "path": (
                F.regexp_count("candidate", F.lit("/")) + F.col("before").rlike(r"[/.]$").cast("int")
                + F.col("after").rlike(r"^[/.]\w").cast("int")
            ).cast("double"),
            "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "previous": F.lower(F.regexp_extract("before", r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)),
            "next": F.lower(F.regexp_extract("after", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1)),
        }
    )
    # Equal candidates are measured once, under a hash, so that no piece of a long one carries the whole.
    key = F.sha2("candidate", 256).alias("key")
    each = found.select(key, F.lower("candidate").alias("low")).distinct()
    windows = lambda n: F.explode_outer(_pieces("low", n))
    covered = (
        each.select("key", windows(3).alias("triple"))
        .join(F.broadcast(triples.withColumn("known", F.lit(1))), "triple", "left")
        .groupBy("key")
        .agg(F.avg(F.coalesce("known", F.lit(0))).alias("coverage"))
    )
    likely = (
        each.select("key", windows(2).alias("pair"))
        .join(F.broadcast(pairs), "pair", "left")
        .groupBy("key")
        .agg(F.avg(F.coalesce("log", F.lit(-10.0))).alias("transition"))
    )
    # A table of its own, so that the join can split a candidate that many rows share.
    return shaped.withColumn("key", key).join(stored(covered.join(likely, "key"), "measures"), "key").drop("key")


# Documented formats of access keys and tokens.
FORMATS = [
    "AKIA[0-9A-Z]{16}",
    "gh[pousr]_[0-9A-Za-z]{36}",
    "xox[abprs]-[0-9A-Za-z-]{10,}",
    "AIza[0-9A-Za-z_-]{35}",
    "sk_live_[0-9A-Za-z]{24,}",
]


def known_findings(described: DataFrame) -> DataFrame:
    """Labelled findings: `target` 1 or 0 where a documented format or plain wording decides, else null.

    Secret: one of `FORMATS`; a hexadecimal value of 16 digits or more, or 40
    characters of base 64 in both cases with a digit, given to a name of password,
    token, secret or key; a password with letters, digits and a mark given to a name
    of password, or in an address. No secret: letters alone in one case, or
    capitalised; numbers alone; words in lower case with slashes or hyphens;
    a hexadecimal value named as a digest, revision or id.
    """
    candidate, before = F.col("candidate"), F.col("before")
    name = F.col("previous").rlike("pass(word|wd|phrase)s?$|pwds?$|tokens?$|secrets?$|keys?$") & (F.col("assigned") == 1)
    hexadecimal = candidate.rlike("^[0-9a-fA-F]{16,}$") & candidate.rlike("[a-fA-F]")
    mixed = candidate.rlike("[a-z]") & candidate.rlike("[A-Z]") & candidate.rlike("[0-9]")
    spoken = F.col("previous").rlike("^(pass(word|wd|phrase)|pwd)s?$") & (F.col("assigned") == 1)
    marked = candidate.rlike("[A-Za-z]") & candidate.rlike("[0-9]") & candidate.rlike(r"[^A-Za-z0-9\s]") & ~candidate.rlike(r"\s")
    secret = (
        candidate.rlike(f"^(?:{'|'.join(FORMATS)})$")
        | (name & (hexadecimal | (candidate.rlike("^[A-Za-z0-9+/]{40}$") & mixed)))
        | (marked & (spoken | before.rlike("://[^:]*:$")))
    )
    plain = (
        candidate.rlike("^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$")
        | candidate.rlike("^[a-z/-]+$")
        | (hexadecimal & F.col("previous").rlike("^(?:sha[0-9]*|md5|digest|checksum|hash|commit|revision|rev|id|uuid|etag)$"))
    )
    return described.withColumn("target", F.when(secret, 1).when(plain, 0))


def _records(sample: DataFrame, word: str, rate: str) -> tuple[DataFrame, DataFrame]:
    """Smoothed share of secrets beside a word, for the most frequent words of the sample; and the same by
    `fold` without the findings of that fold."""
    smooth = lambda a, n: ((a + 2) / (n + 4)).alias(rate)
    folds = sample.groupBy(word, "fold").agg(F.sum("target").alias("a"), F.count("*").alias("n"))
    folds = stored(folds, "folds")
    top = folds.groupBy(word).agg(F.sum("a").alias("all_a"), F.sum("n").alias("all_n"))
    top = stored(top.orderBy(F.desc("all_n"), word).limit(NEIGHBOURS), "records")
    others = folds.join(F.broadcast(top), word).select(word, "fold", smooth(F.col("all_a") - F.col("a"), F.col("all_n") - F.col("n")))
    return top.select(word, smooth(F.col("all_a"), F.col("all_n"))), others


class SecretForest:
    """A forest of decision trees over candidates, and the records of neighbouring words."""

    def __init__(self, model: RandomForestClassificationModel | None, previous: DataFrame, following: DataFrame):
        self.model, self.previous, self.following = model, previous, following
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")

    @classmethod
    def fit(
        cls, labelled: DataFrame, per_class: int = SAMPLE_PER_CLASS, trees: int = TREES, depth: int = DEPTH
    ) -> SecretForest:
        """Train on described candidates with a `target`; nulls are not labelled.

        At most `per_class` rows of each class are used, those of least hash of
        candidate and context. Without rows of both classes there is no forest and every
        candidate keeps probability 1/2.
        """
        rows = labelled.filter("target IS NOT NULL")
        order = F.xxhash64("candidate", "before", "after")
        part = lambda c: rows.filter(F.col("target") == c).orderBy(order, "candidate").limit(per_class)
        # A candidate is in one fold, wherever it occurs.
        sample = part(0).unionByName(part(1)).withColumn("fold", F.pmod(F.xxhash64("candidate"), F.lit(FOLDS)))
        sample = stored(sample, "sample")
        previous, previous_others = _records(sample, "previous", "previous_record")
        following, following_others = _records(sample, "next", "next_record")
        forest = cls(None, previous, following)
        if sample.select("target").distinct().count() < 2:
            return forest
        classifier = RandomForestClassifier(
            labelCol="target", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED
        )
        # No finding's own label is in the records that it is learned with.
        vectors = forest._vectors(sample, previous_others, following_others, ["fold"])
        forest.model = classifier.fit(vectors.select("features", "target"))
        return forest

    def _vectors(self, described: DataFrame, previous: DataFrame, following: DataFrame, by: list[str]) -> DataFrame:
        # Both tables have at most NEIGHBOURS rows a fold.
        rows = described.join(F.broadcast(previous), ["previous", *by], "left").join(
            F.broadcast(following), ["next", *by], "left"
        )
        return self.assembler.transform(rows.fillna(0.5, ["previous_record", "next_record"]))

    def judged(self, described: DataFrame, threshold: float = 0.5) -> DataFrame:
        """`probability` of a secret, and `kept` for those of at least `threshold`."""
        rows = self._vectors(described, self.previous, self.following, [])
        if self.model is None:
            rows = rows.withColumn("p", F.lit(0.5))
        else:
            rows = self.model.transform(rows).withColumn("p", vector_to_array("probability")[1])
        return rows.select(
            "doc_id", "start", "candidate", "previous", "next", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("kept")
        )


def scanned(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate of `docs` (`doc_id`, `text`) with its probability of being a secret, and `kept`.

    The forest learns from the findings of `docs` that documented formats label and
    from `findings`, texts (`text`, `target` 1 or 0) whose candidates all have that
    label. What neither shows, it cannot know: secrets of forms that are in none of
    them may get a low probability, but none is left out.

    The forest sees length, make-up and letter transitions of a candidate, how far
    the corpus's words cover it, whether it lies in a path, and the words beside
    it, not the formats that labelled the findings it learned from. Rows stand
    for themselves, so repeated and null `doc_id`s are kept as they are; a text may
    be as long as a value can be.
    """
    docs = docs.select("doc_id", "text")
    found = stored(candidates(docs), "candidates")
    measures = dictionary(docs)
    rows = stored(known_findings(described(found, *measures)), "described")
    labelled = rows
    if findings is not None:
        # The label goes through as the id of its text.
        given = candidates(findings.select(F.col("target").alias("doc_id"), "text"))
        given = described(given, *measures).withColumn("target", F.col("doc_id").cast("int"))
        labelled = rows.drop("doc_id").unionByName(given.drop("doc_id"))
    return SecretForest.fit(labelled).judged(rows)
