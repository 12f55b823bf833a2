"""Statistics over groups of samples, significance checks, and equations."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def float_list(values) -> Column:
    """Array of doubles: what cannot be cast is left out; null gives an empty array."""
    c = F.col(values) if isinstance(values, str) else values
    return F.coalesce(F.filter(F.transform(c, lambda x: x.try_cast("double")), lambda x: x.isNotNull()), F.array().cast("array<double>"))


def digits(value) -> int:
    """Places to round to; 0, null and blanks mean six."""
    return int(value or 6)


def rounded(c: Column, places: int = 6) -> Column:
    """Half to even."""
    return F.bround(c, places)


def two_samples(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """n, mean and sample variance of two groups by ``keys``, in one partially aggregated shuffle."""
    pick = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    cols = [f(pick(g)).alias(f"{name}_{side}") for side, g in (("a", a), ("b", b)) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    return df.groupBy(*keys).agg(*cols)


def effect_size(samples: DataFrame, places: int = 6) -> DataFrame:
    """Cohen's d of :func:`two_samples`: missing under two samples a side or without variance."""
    n = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.greatest(n, F.lit(1))
    ok = F.coalesce((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled > 0), F.lit(False))
    d = F.when(ok, rounded((F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled), places))
    return samples.withColumns({"status": F.when(ok, F.lit("ok")).otherwise(F.lit("missing")), "effect_size": d})


def t_statistic(samples: DataFrame, equal_var: bool = False, places: int = 6) -> DataFrame:
    """t of two independent groups (Welch, or pooled), its degrees of freedom (pooled only), the normal p-value."""
    na, nb = F.col("n_a"), F.col("n_b")
    if equal_var:
        pooled = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / F.greatest(na + nb - 2, F.lit(1))
        error, df = F.sqrt(pooled * (1 / na + 1 / nb)), na + nb - 2
    else:
        error, df = F.sqrt(F.col("var_a") / na + F.col("var_b") / nb), F.lit(None).cast("long")
    ok = F.coalesce((na >= 2) & (nb >= 2) & (error > 0), F.lit(False))
    t = F.when(ok, (F.col("mean_a") - F.col("mean_b")) / error)
    return samples.withColumns({"status": F.when(ok, F.lit("ok")).otherwise(F.lit("missing")), "t_stat": rounded(t, places), "df": F.when(ok, df), "p_value": rounded(two_sided(t), places)})


def paired_t(df: DataFrame, keys: list[str], a: str, b: str, places: int = 6) -> DataFrame:
    """t of paired samples."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"))
    ok = F.coalesce((F.col("n") >= 2) & (F.col("var") > 0), F.lit(False))
    t = F.when(ok, F.col("mean") / F.sqrt(F.col("var") / F.col("n")))
    return out.select(*keys, F.when(ok, F.lit("ok")).otherwise(F.lit("missing")).alias("status"), rounded(t, places).alias("t_stat"), (F.col("n") - 1).alias("df"), rounded(two_sided(t), places).alias("p_value"))


def two_sided(t: Column) -> Column:
    """Two-sided p-value under the normal distribution, as an expression; null for null and NaN.

    The complementary error function of x = |t| / sqrt(2) is 1 minus a series of positive terms up to x = 5, right to 1e-15,
    and its asymptotic series beyond, where it is below 2e-12.
    """
    x = F.abs(t) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def more(s, n):
        term = s["term"] * (2 * x * x / (2 * n + 1))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 1 - F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, more, lambda s: s["sum"]) * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    y = 1 / (2 * x * x)
    far = F.exp(-x * x) / (x * math.sqrt(math.pi)) * (1 - y * (1 - 3 * y * (1 - 5 * y * (1 - 7 * y))))
    return F.when(~F.isnan(t), F.when(x < 5, F.greatest(near, F.lit(0.0))).otherwise(far))


def significance_claim(claim, given=None) -> Column:
    """significant, not_significant or null: what a claim says."""
    low = F.lower(F.trim(claim))
    said = F.when(F.contains(low, F.lit("significant")), F.when(F.contains(low, F.lit("not")), F.lit("not_significant")).otherwise(F.lit("significant")))
    return said if given is None else F.coalesce(said, F.nullif(given, F.lit("")))


def claim_supported(kind: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(kind == "significant", p < alpha).when(kind.isNotNull(), p >= alpha)


TOGETHER = 1 << 20  # resampled values that are at hand at once


def _resampled(samples: list, n_boot: int, seed: int, stat: str):
    """A row of ``n_boot`` resampled means or medians for each of some samples of one size.

    Every group starts the same stream, so samples of one size share their drawn positions, in blocks of bounded size.
    """
    import numpy as np

    rng, f, n = np.random.default_rng(seed), np.median if stat == "median" else np.mean, len(samples[0])
    out, step = np.empty((len(samples), n_boot)), max(1, TOGETHER // n)
    for begin in range(0, n_boot, step):
        drawn = rng.integers(0, n, size=(min(step, n_boot - begin), n))
        some = max(1, TOGETHER // drawn.size)
        for at in range(0, len(samples), some):
            x = np.array(samples[at : at + some])
            out[at : at + some, begin : begin + step] = f(x.take(drawn, axis=1), axis=2)  # in rows, so that sums are those of one group alone
    return out


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, stat: str = "mean", places: int = 6) -> DataFrame:
    """Percentile interval of resampled means or medians, one group in one task, numpy's PCG64 stream by group.

    The group's values are taken in the order of ``order``, nulls last, as the resampled positions depend on it; they reach
    Python as one array a group, and groups of one size are resampled together. For groups too large for a task use
    :func:`bootstrap_ci_distributed`.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, by_size = batch.column(len(keys)), {}
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            lower, upper = np.full(len(lists), np.nan), np.full(len(lists), np.nan)
            for i, n in enumerate(np.diff(ends).tolist()):
                if n >= 2:
                    by_size.setdefault(n, []).append(i)
            for at in by_size.values():
                drawn = _resampled([flat[ends[i] : ends[i + 1]] for i in at], n_boot, seed, stat)
                low, high = np.percentile(drawn, [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=1)
                lower[at], upper[at] = [round(x, places) for x in low.tolist()], [round(x, places) for x in high.tolist()]
            some = np.diff(ends) >= 2
            sides = [pa.array(x, pa.float64(), mask=~some) for x in (lower, upper)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.where(some, "ok", "missing"), pa.string()), *sides], names=[*keys, "status", "lower", "upper"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    x = F.col(value).cast("double")
    kept = F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("at"), x.alias("x")))
    groups = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["x"]).alias("x"))
    return groups.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "status string, lower double, upper double"]))


def bootstrap_ci_distributed(df: DataFrame, keys: list[str], value: str, unit: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of the mean for groups of any size: each row draws its weight in each replicate from a
    hash of (unit, replicate, seed), and replicates are partial sums. The order of rows does not matter."""
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("r"), F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    weight, mass, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):
        mass += p
        weight = weight + (u > mass).cast("int")
        p /= k + 1
    drawn = df.select(*keys, value, unit).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("w", weight)
    means = drawn.groupBy(*keys, "r").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(alpha / 2)).alias("lower"), F.percentile("m", F.lit(1 - alpha / 2)).alias("upper"))


def auto_k(n: int, target: int | None = None, explicit: int | None = None) -> int:
    """Number of clusters: given, or by target size, or the rounded root of n (half to even), two at least."""
    if explicit:
        return min(explicit, max(1, n))
    if target:
        return max(1, math.ceil(n / target))
    return 1 if n <= 1 else max(2, round(math.sqrt(n)))


# --- equations -----------------------------------------------------------------------------------------

_BINARY = {ast.Add: ("Add", operator.add), ast.Sub: ("Sub", operator.sub), ast.Mult: ("Mult", operator.mul), ast.Div: ("Div", operator.truediv), ast.Pow: ("Pow", operator.pow)}


class EquationError(ValueError):
    pass


def parse_equation(text: str | None, mode: str = "latex") -> ast.expr:
    """Arithmetic over names and numbers, from LaTeX-like or plain text; anything else is refused."""
    text = str(text or "").strip()
    if not text:
        raise EquationError("missing_expression")
    if mode == "latex":
        text = text.translate(str.maketrans({"{": "(", "}": ")"})).replace(r"\cdot", "*").replace(r"\times", "*").replace("^", "**")
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise EquationError(f"ast_parse_error:{e}") from None
    for node in ast.walk(tree):
        fine = isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Name, ast.expr_context, ast.UAdd, ast.USub, *_BINARY)) or (isinstance(node, ast.Constant) and isinstance(node.value, (int, float)))
        if not fine:
            raise EquationError("unsupported_expression")
    return tree


def canonical(node: ast.expr) -> str:
    """One text for equal structures: the two sides of each sum and product are put in order."""
    if isinstance(node, ast.BinOp):
        left, right = canonical(node.left), canonical(node.right)
        if isinstance(node.op, (ast.Add, ast.Mult)):
            left, right = sorted((left, right))
        return f"{_BINARY[type(node.op)][0]}({left},{right})"
    if isinstance(node, ast.UnaryOp):
        return f"{type(node.op).__name__}({canonical(node.operand)})"
    return node.id if isinstance(node, ast.Name) else repr(node.value)


def symbols(node: ast.expr) -> list[str]:
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)})


def _power(node: ast.expr) -> float:
    if isinstance(node, ast.Constant):
        return float(node.value)
    if isinstance(node, ast.UnaryOp):
        return -_power(node.operand) if isinstance(node.op, ast.USub) else _power(node.operand)
    raise EquationError("non_numeric_exponent")


def dimension(node: ast.expr, units: dict[str, dict[str, float]]) -> dict[str, float]:
    """Exponents of base units; sums need equal dimensions and powers a number."""
    if isinstance(node, ast.Constant):
        return {}
    if isinstance(node, ast.Name):
        if node.id not in units:
            raise EquationError(f"unknown_symbol:{node.id}")
        return {k: float(v) for k, v in units[node.id].items()}
    if isinstance(node, ast.UnaryOp):
        return dimension(node.operand, units)
    left = dimension(node.left, units)
    if isinstance(node.op, ast.Pow):
        e = _power(node.right)
        return {k: v * e for k, v in left.items()}
    right = dimension(node.right, units)
    if isinstance(node.op, (ast.Add, ast.Sub)):
        if left != right:
            raise EquationError("dimension_mismatch")
        return left
    sign = 1 if isinstance(node.op, ast.Mult) else -1
    total = {k: left.get(k, 0.0) + sign * right.get(k, 0.0) for k in left.keys() | right.keys()}
    return {k: v for k, v in total.items() if abs(v) >= 1e-12}


_EQUATION = "status string, expression string, canonical string, symbols string"


def equation(latex, mode: str = "latex") -> Column:
    """struct<status, expression, canonical, symbols> of an equation."""

    @F.pandas_udf(_EQUATION)
    def run(text):
        import pandas as pd

        rows = []
        for t in text:
            try:
                tree = parse_equation(t, mode)
                rows.append(("ok", ast.unparse(tree), canonical(tree), ",".join(symbols(tree))))
            except EquationError as e:
                rows.append(("fail", str(e), None, None))
        return pd.DataFrame(rows, columns=["status", "expression", "canonical", "symbols"])

    return run(latex)


def same_structure(a, b, mode: str = "latex") -> Column:
    """Whether two equations have one canonical form; null if either cannot be read."""
    x, y = equation(a, mode)["canonical"], equation(b, mode)["canonical"]
    return x == y


def dimensions_agree(lhs, rhs, units: dict, mode: str = "python") -> Column:
    """struct<status, consistent>: whether both sides have one dimension."""

    @F.pandas_udf("status string, consistent boolean")
    def run(left, right):
        import pandas as pd

        rows = []
        for x, y in zip(left, right, strict=True):
            try:
                rows.append(("ok", dimension(parse_equation(x, mode), units) == dimension(parse_equation(y, mode), units)))
            except EquationError:
                rows.append(("fail", None))
        return pd.DataFrame(rows, columns=["status", "consistent"])

    return run(lhs, rhs)
