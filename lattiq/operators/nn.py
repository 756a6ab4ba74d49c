"""Layers and likelihoods on array columns, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v)


def bound(x: Column, f) -> Column:
    """f of x, with x computed once: it is the only element of an array, and f runs over that."""
    return F.transform(F.array(x), f)[0]


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def affine(x: Column, weights: Column, bias: Column) -> Column:
    return F.zip_with(F.transform(weights, lambda row: dot(x, row)), bias, lambda a, b: a + b)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0).cast("double")))


def softmax(x: Column, floor: float = 1e-20) -> Column:
    over = lambda e: bound(total(e), lambda s: F.transform(e, lambda v: F.greatest(v / s, F.lit(floor))))
    return bound(F.transform(x, F.exp), over)


def groups(x: Column, k: int) -> Column:
    """The array in consecutive groups of k."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / k).cast("int") - 1), lambda g: F.slice(x, g * k + 1, F.lit(k)))


def p_norm(x: Column, k: int) -> Column:
    return F.transform(groups(x, k), lambda g: F.sqrt(dot(g, g)))


def sum_group(x: Column, k: int) -> Column:
    return F.transform(groups(x, k), total)


def rms_normalise(x: Column) -> Column:
    """x over its root mean square, the factor capped at 1."""
    factor = lambda y: F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(1.0), F.sqrt(dot(y, y) / F.size(y)))), F.lit(1.0))
    return bound(x, lambda y: bound(factor(y), lambda s: F.transform(y, lambda v: v * s)))


def scale(x: Column, factors: Column) -> Column:
    return F.zip_with(x, factors, lambda a, b: a * b)


def gather(codebook: Column, index: Column) -> Column:
    """Codebook values at 1-based places."""
    return F.transform(index, lambda i: F.element_at(codebook, i))


def log_posterior(x: Column, prior: Column) -> Column:
    """ln of x over the prior, made to sum to one."""
    return bound(F.zip_with(x, prior, lambda a, b: a / b), lambda y: bound(total(y), lambda s: F.transform(y, lambda v: F.ln(v / s))))


def log_add(a: Column, b: Column, cut: float = -23.02585) -> Column:
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo - hi < cut, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def gaussian(x: Column, mean: Column, inverse_variance: Column, constant: Column) -> Column:
    """Log-likelihood of a diagonal Gaussian."""
    d = total(F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), inverse_variance, lambda a, b: a * b))
    return F.lit(-0.5) * (constant + d)


def clamp(x: Column, lo: float = 1e-30, hi: float = 1e30) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def sum_ragged(x: Column, sizes: Column) -> Column:
    """Sums of consecutive groups of the given sizes."""
    start = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, n: a + n)
    return F.transform(sizes, lambda n, k: total(F.slice(x, start(k) + 1, n)))


def vq_affine(x: Column, codebook: Column, index: Column, bias: Column) -> Column:
    """An affine layer whose weights are code words: dot products with the code words once, then sums by 1-based index.

    codebook: array of code words of dim values; index: for each output one code word for each of the len(x) / dim pieces of x.
    """
    dim = F.size(F.element_at(codebook, 1))
    pieces = F.transform(F.sequence(F.lit(0), (F.size(x) / dim).cast("int") - 1), lambda g: F.slice(x, g * dim + 1, dim))
    dots = F.transform(pieces, lambda p: F.transform(codebook, lambda c: dot(p, c)))
    out = lambda d: F.transform(index, lambda row: total(F.transform(row, lambda i, g: F.element_at(F.element_at(d, g + 1), i))))
    return F.zip_with(F.transform(F.array(dots), out)[0], bias, lambda a, b: a + b)  # dots are an argument, computed once


def mixture(x: Column, mixtures: Column) -> Column:
    """Log-likelihood of a Gaussian mixture: structs (lw, mu, iv, g) of log weight, means, inverse variances and constant."""
    each = F.transform(mixtures, lambda m: m["lw"] + gaussian(x, m["mu"], m["iv"], m["g"]))
    best = lambda e: F.array_max(e)
    return F.transform(F.array(each), lambda e: best(e) + F.ln(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - best(e)))))[0]


def usable(mixtures: Column, least: float) -> Column:
    """Mixtures whose log weight is not below least; weights stay as they are."""
    return F.filter(mixtures, lambda m: m["lw"] >= least)


def padded_dim(x: Column, multiple: int = 4) -> Column:
    """x with zeros up to a multiple of values."""
    lack = F.pmod(-F.size(x), F.lit(multiple))
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("double"), lack))


def exact32(c: Column) -> Column:
    """c, which must fit in 32 bits with sign; anything else is an error."""
    return F.when(c.between(-(1 << 31), (1 << 31) - 1), c).otherwise(F.raise_error(F.concat(F.lit("no 32-bit number: "), c.cast("string"))).cast("long"))


def fixed_gaussian(x: Column, mean: Column, inverse_variance: Column, constant: Column) -> Column:
    """Log-likelihood of a diagonal Gaussian in 32-bit integers with shifts (towards the lower number); arrays of whole numbers."""

    def term(d: Column, v: Column) -> Column:
        return F.shiftright(exact32(F.shiftright(exact32(d * v), 17) * d), 1)

    whole = lambda c: F.transform(c, lambda v: exact32(v.cast("long")))
    apart = F.transform(F.zip_with(whole(x), whole(mean), lambda a, b: a - b), exact32)
    terms = F.zip_with(apart, whole(inverse_variance), term)
    far = F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: exact32(a + t))
    return bound(F.shiftright(far, 2), lambda s: -F.shiftright(exact32(s + constant.cast("long")), 1))


def fixed_mixture(x: Column, mixtures: Column) -> Column:
    """The best of the mixtures, structs (mu, iv, g) of whole numbers; -2147483647 where there is none."""
    each = F.transform(mixtures, lambda m: fixed_gaussian(x, m["mu"], m["iv"], m["g"]))
    return F.greatest(F.lit(-2147483647).cast("long"), F.coalesce(F.array_max(each), F.lit(-2147483647).cast("long")))


def transition(matrix: Column, states: Column, at: Column, to: Column) -> Column:
    """The entry of a row-major matrix of states by states."""
    return F.element_at(matrix, (at * states + to + 1).cast("int"))
