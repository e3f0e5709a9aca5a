"""Quality rules: counts over words and lines, and robust outliers of their rates by language and source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import scratch, text_or_empty

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]

#: The rates that make a text's vector: count, transformation, and the least standard deviation that is told apart. The
#: square root and the logarithm keep the spread of a rate from growing with the rate.
RATES = {"chars": ("word_chars", F.log, 0.05), "symbols": ("n_symbols", F.sqrt, 0.08), "upper": ("n_upper", F.sqrt, 0.06), "repeats": ("n_dup_words", F.sqrt, 0.08)}
#: Words of the group's own median rate that each text's rates are blended with: rates of few words say little.
PRIOR_WORDS = 50
#: Share of a key's rows that its estimate rests on: those of the least determinant.
CORE = 0.75
#: Concentration steps from every start, and further ones from the start that then has the least determinant.
FIRST_STEPS, MORE_STEPS = 2, 2
#: Ranks of medians and of CORE are right to one in so many; a task's summary of a key has some thousand numbers at most.
ACCURACY = 1000
#: Median and upper 0.1 % point of chi-squared with four degrees of freedom.
CHI_MEDIAN, CHI_TOP = 3.3567, 18.467
#: Rows that a language's estimate counts for in its groups', and the whole corpus's in a language's.
PRIOR_ROWS = 100
#: Key of the whole corpus; those of languages are empty or begin with "=".
WHOLE = "*"
#: Keys (groups, languages and the whole) up to which their estimates, below 1.5 kB each, are broadcast.
FEW_KEYS = 20_000
#: Parts that each key's rows are dealt into for a join with more estimates than that.
SALTS = 64
DIMENSIONS = list(RATES)
FLOORS = [floor for _, _, floor in RATES.values()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though it stands inside loops."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more in the list; runs are told apart by 64-bit hashes."""

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    def twice(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
        return let(F.sort_array(F.array_compact(marked)), covered)

    def count(r: Column) -> Column:
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(let(F.sort_array(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(runs(h), count)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``_q`` of the counts: n_words, word_chars, n_symbols, n_dup_lines, n_dup_words, n_upper, n_repeat_words.

    n_dup_words are the words of lines that equal an earlier line, n_upper the upper-case letters; null texts are empty.
    """
    body = text_or_empty(text)
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size_of = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    return docs.withColumn("_q", let(F.struct(words.alias("words"), lines.alias("lines")), lambda v: F.struct(
        F.size(v["words"]).cast("long").alias("n_words"),
        size_of(v["words"]).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size(v["lines"]) - F.size(F.array_distinct(v["lines"]))).cast("long").alias("n_dup_lines"),
        F.greatest(F.lit(0), F.round(F.size(v["words"]) * (F.lit(1.0) - size_of(F.array_distinct(v["lines"])) / F.greatest(size_of(v["lines"]), F.lit(1))))).cast("long").alias("n_dup_words"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        repeated_words(v["words"]).cast("long").alias("n_repeat_words"),
    )))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def group_of(lang: str = "lang", source: str = "source") -> Column:
    """One key for language and source; nulls make a group of their own."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.concat_ws("\x1f", mark(lang), mark(source))


def _rates(q: Column, medians: Column) -> list[Column]:
    """The vector of a text: its rates a word, blended with the group's medians, and transformed."""
    return [of((q[count] + PRIOR_WORDS * medians[name]) / (q["n_words"] + PRIOR_WORDS)).alias(name) for name, (count, of, _) in RATES.items()]


def join_few(rows: DataFrame, few: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """Rows with the ``n`` rows of ``few`` for their key: broadcast where these are few, else each key's rows are split."""
    if n <= FEW_KEYS:
        return rows.join(F.broadcast(few), key, how)
    split = rows.withColumn("_salt", F.monotonically_increasing_id() % SALTS)
    return split.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"], how).drop("_salt")


def distance(vector: list[Column], e: Column) -> Column:
    """The squared Mahalanobis distance, by forward substitution in the scatter's triangular factor."""
    z: list[Column] = []
    for i, x in enumerate(vector):
        rest = x - e["center"][i]
        for j, y in enumerate(z):
            rest = rest - e["factor"][i * (i + 1) // 2 + j] * y
        z.append(rest / e["factor"][i * (i + 1) // 2 + i])
    return sum((y * y for y in z[1:]), z[0] * z[0])


def _at(i: int, j: int) -> int:
    """Where a lower triangle, row by row, has its element i, j."""
    return i * (i + 1) // 2 + j


TRIANGLE = [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """From center and cov (a lower triangle): center, and the scatter's triangular factor, kept off zero by FLOORS."""
    factor: dict[tuple[int, int], Column] = {}
    for i, j in TRIANGLE:
        rest = F.col("cov")[_at(i, j)] + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
        factor[i, j] = F.col(f"l_{i}_{j}")
    return df.select(*keys, "center", F.array(*(factor[x] for x in TRIANGLE)).alias("factor"))


def _starts(vectors: DataFrame, n: int, first: DataFrame) -> DataFrame:
    """Three estimates for each key: its medians, with scatters of its median deviations and either no correlations, or
    those of the deviations' hyperbolic tangents, or those of their directions. The last two hardly move by outliers."""
    d = len(DIMENSIONS)
    off = [F.col(c) - F.col("center")[i] for i, c in enumerate(DIMENSIONS)]
    wide = join_few(vectors, first, "key", n).groupBy("key").agg(F.array(*(F.percentile_approx(F.abs(x), 0.5, ACCURACY) for x in off)).alias("mad"))
    spread = scratch(first.join(wide, "key").select("key", "center", F.transform("mad", lambda m: 1.4826 * m).alias("sd")), "quality-spread")
    at = join_few(vectors, spread, "key", n).select("key", *((x / (F.col("sd")[i] + FLOORS[i])).alias(f"z{i}") for i, x in enumerate(off)))
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    kinds = {"tanh": lambda i: F.tanh(F.col(f"z{i}")), "sign": lambda i: F.col(f"z{i}") / length}
    sums = at.groupBy("key").agg(*(F.avg(u(i) * u(j)).alias(f"{kind}_{i}_{j}") for kind, u in kinds.items() for i, j in TRIANGLE))
    sd = F.col("sd")
    plain = F.array(*(sd[i] * sd[i] if i == j else F.lit(0.0) for i, j in TRIANGLE))
    like = lambda kind: F.array(*(sd[i] * sd[j] * (F.lit(1.0) if i == j else F.coalesce(F.try_divide(F.col(f"{kind}_{i}_{j}"), F.sqrt(F.col(f"{kind}_{i}_{i}") * F.col(f"{kind}_{j}_{j}"))), F.lit(0.0))) for i, j in TRIANGLE))
    both = spread.join(sums, "key").select("key", "center", F.posexplode(F.array(plain, *map(like, kinds))).alias("start", "cov"))
    return scratch(_factored(both, ["key", "start"]), "quality-starts")


def _step(vectors: DataFrame, n: int, estimate: DataFrame) -> DataFrame:
    """Centers and scatters of the CORE share of each estimate's rows that are nearest to it; the determinant can't grow."""
    x = [F.col(c) for c in DIMENSIONS]
    at = join_few(vectors, estimate, "key", n).select("key", "start", *DIMENSIONS, "center", distance(x, F.struct("center", "factor")).alias("d2"))
    near = at.groupBy("key", "start").agg(F.percentile_approx("d2", CORE, ACCURACY).alias("most"))
    near = near.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("start", "most"))).alias("most"))
    core = join_few(at, near, "key", n).where(F.col("d2") <= F.col("most")[F.col("start")])
    off = [c - F.col("center")[i] for i, c in enumerate(x)]
    sums = core.groupBy("key", "start").agg(*(F.avg(o).alias(f"s_{i}") for i, o in enumerate(off)), *(F.avg(off[i] * off[j]).alias(f"s_{i}_{j}") for i, j in TRIANGLE))
    sums = sums.join(estimate.select("key", "start", F.col("center").alias("old")), ["key", "start"])
    center = F.array(*(F.col("old")[i] + F.col(f"s_{i}") for i in range(len(x)))).alias("center")
    cov = F.array(*(F.col(f"s_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") for i, j in TRIANGLE)).alias("cov")
    return scratch(_factored(sums.select("key", "start", center, cov), ["key", "start"]), "quality-step")


def concentrated(vectors: DataFrame) -> DataFrame:
    """key, n, center and cov (the lower triangle) of each key's rows, by minimum covariance determinant.

    From each of three starts, FIRST_STEPS rounds take the CORE share of rows nearest in Mahalanobis distance and set
    center and scatter to theirs; the start whose scatter then has the least determinant goes on for MORE_STEPS. In the
    end the scatter is widened until the distances' median is no more than that of chi-squared. Each round is an
    aggregate of narrow rows, combined in the tasks and written to the shared folder; every row takes part.
    """
    x = [F.col(c) for c in DIMENSIONS]
    first = scratch(vectors.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(c, 0.5, ACCURACY) for c in x)).alias("center")), "quality-centers")
    n = first.count()
    estimate = _starts(vectors, n, first.select("key", "center"))
    for _ in range(FIRST_STEPS):
        estimate = _step(vectors, n, estimate)
    determinant = sum((F.log(F.col("factor")[_at(i, i)]) for i in range(1, len(x))), F.log(F.col("factor")[0]))
    estimate = estimate.groupBy("key").agg(F.min_by(F.struct("center", "factor"), F.struct(determinant.alias("d"), "start")).alias("e")).select("key", F.lit(0).alias("start"), "e.*")
    for _ in range(MORE_STEPS):
        estimate = _step(vectors, n, estimate)
    ends = join_few(vectors, estimate, "key", n).groupBy("key").agg(F.percentile_approx(distance(x, F.struct("center", "factor")), 0.5, ACCURACY).alias("median"))
    scale = F.greatest(F.col("median") / CHI_MEDIAN, F.lit(1.0))
    f = lambda i, j: F.col("factor")[_at(i, j)]
    cov = [scale * sum((f(i, k) * f(j, k) for k in range(1, j + 1)), f(i, 0) * f(j, 0)) for i, j in TRIANGLE]
    return scratch(estimate.join(ends, "key").join(first.select("key", "n"), "key").select("key", "n", "center", F.array(*cov).alias("cov")), "quality-concentrated")


def _share(n: Column) -> Column:
    return n / (n + PRIOR_ROWS)


def _pooled(own: str, wide: str) -> list[Column]:
    """center and cov of the struct ``own`` drawn towards those of ``wide``, with the spread between both centers."""
    w = _share(F.col(f"{own}.n"))
    mix = lambda name, i: w * F.col(f"{own}.{name}")[i] + (1 - w) * F.col(f"{wide}.{name}")[i]
    apart = [F.col(f"{own}.center")[i] - F.col(f"{wide}.center")[i] for i in range(len(DIMENSIONS))]
    cov = [mix("cov", _at(i, j)) + w * (1 - w) * apart[i] * apart[j] for i, j in TRIANGLE]
    return [F.array(*(mix("center", i) for i in range(len(DIMENSIONS)))).alias("center"), F.array(*cov).alias("cov")]


def _drawn(keyed: DataFrame, drawn: Callable[[str, str], list[Column]]) -> DataFrame:
    """From rows of all keys: those of groups, drawn towards their language's, themselves drawn towards the whole's."""
    grouped = F.instr("key", "\x1f") > 0
    whole = keyed.where(F.col("key") == WHOLE).alias("w")
    languages = keyed.where(~grouped & (F.col("key") != WHOLE)).alias("l").join(F.broadcast(whole)).select(F.col("l.key").alias("lang"), *drawn("l", "w")).alias("l")
    groups = keyed.where(grouped).withColumn("lang", F.substring_index("key", "\x1f", 1)).alias("g")
    return groups.join(languages, F.col("g.lang") == F.col("l.lang")).select(F.col("g.key").alias("group"), *drawn("g", "l"))


def fit(counted: DataFrame) -> DataFrame:
    """group, medians, center, factor and limit for each group that has words.

    ``counted`` has group and q. Groups, languages and the whole corpus are estimated alike; a language's numbers are
    drawn towards the corpus's, and a group's towards its language's, with the weight of PRIOR_ROWS rows. So groups of
    any size are judged. The limit is the upper 0.1 % point of chi-squared.
    """
    rows = counted.where("q.n_words > 0").withColumn("lang", F.substring_index("group", "\x1f", 1))
    key = F.explode(F.array("group", "lang", F.lit(WHOLE))).alias("key")
    per_word = [F.count("*").alias("n"), *(F.percentile_approx(F.col(f"q.{count}") / F.col("q.n_words"), 0.5, ACCURACY).alias(name) for name, (count, _, _) in RATES.items())]
    wide = scratch(rows.select(key, "q").groupBy("key").agg(*per_word), "quality-wide")
    toward = lambda own, other: [(_share(F.col(f"{own}.n")) * F.col(f"{own}.{c}") + (1 - _share(F.col(f"{own}.n"))) * F.col(f"{other}.{c}")).alias(c) for c in DIMENSIONS]
    medians = scratch(_drawn(wide, toward).select("group", F.struct(*DIMENSIONS).alias("medians")), "quality-medians")
    vectors = join_few(rows, medians, "group", medians.count()).select(key, *_rates(F.col("q"), F.col("medians")))
    drawn = _drawn(concentrated(scratch(vectors, "quality-vectors")), _pooled)
    # FLOORS are in cov already, and _factored adds them
    bare = F.array(*(F.col("cov")[_at(i, j)] - (FLOORS[i] ** 2 if i == j else 0.0) for i, j in TRIANGLE))
    estimate = _factored(drawn.withColumn("cov", bare), ["group"])
    return scratch(estimate.join(medians, "group").select("group", "medians", "center", "factor", F.lit(CHI_TOP).alias("limit")), "quality-estimates")


def kept(q: Column, e: Column) -> Column:
    """False for texts that fail the base rules or lie beyond their group's limit."""
    return ~base_failed(q) & F.coalesce(distance(_rates(q, e["medians"]), e) <= e["limit"], F.lit(True))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    Null texts have no words and fail. Null languages and sources make groups of their own; ties and repeated rows have
    equal verdicts; empty tables give none. Estimates are few numbers a group, broadcast if
    there are FEW_KEYS at most; else each group's rows are split for their join.
    """
    counted = with_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), group_of(lang, source).alias("group")))
    counted = scratch(counted.select("doc_id", "group", F.col("_q").alias("q")), "quality-counts")
    judged = _judged(counted)
    return judged.select("doc_id", *(F.col(f"q.{c}") for c in COUNTS), "q.n_repeat_words", base_failed(F.col("q")).alias("base_failed"), kept(F.col("q"), F.struct(*ESTIMATE)).alias("kept"))


ESTIMATE = ["medians", "center", "factor", "limit"]


def _judged(counted: DataFrame) -> DataFrame:
    """Rows with group and q, and the estimate of their group; groups without any words have none."""
    estimates = fit(counted)
    return join_few(counted, estimates, "group", estimates.count(), "left")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns.

    Rows are written with their counts, which are worked out once. Nulls, ties, repeated rows and empty tables as in
    ``quality_rules``; columns of any name pass.
    """
    counted = with_counts(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("text"), group_of(lang, source).alias("group")))
    counted = scratch(counted.select("_row", "group", F.col("_q").alias("q")), "quality-counts")
    return _judged(counted).where(kept(F.col("q"), F.struct(*ESTIMATE))).select("_row.*")
