"""Column functions on texts, labels and scores (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG10_E = 0.4342944819


def words(text: Column) -> Column:
    """Tokens at single spaces; inner empty tokens stay, trailing ones go."""
    return F.split(F.regexp_replace(text, " +$", ""), " ")


def characters(text: Column) -> Column:
    """Tokens as in words(), but every token that is not pure ASCII falls into its characters."""
    return F.flatten(F.transform(words(text), lambda t: F.when(is_ascii(t), F.array(t)).otherwise(F.split(t, ""))))


def syllables(text: Column, table: Column, default: str = "UNK") -> Column:
    """The characters() of a text looked up in a map column; what is missing becomes default."""
    return F.transform(characters(text), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(default)))


def is_ascii(s: Column) -> Column:
    return F.char_length(s) == F.octet_length(s)


def is_cjk(ch: Column) -> Column:
    """One character in U+4E00 .. U+9FA5."""
    return ch.between("一", "龥")


def is_number(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def without_extension(name: Column) -> Column:
    return F.left(name, F.greatest(F.char_length(name) - 4, F.lit(0)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def clean_id(s: Column) -> Column:
    return F.regexp_replace(s, r"[(|)]", "")


def to_ln(log10: Column) -> Column:
    return log10 * F.ln(F.lit(10.0))


def to_log10(ln: Column) -> Column:
    return ln * F.lit(LOG10_E)


def triphone(left: Column, centre: Column, right: Column) -> Column:
    return F.format_string("%s-%s+%s", left, centre, right)


def triphone_parts(label: Column) -> Column:
    return F.split(label, "[-+]")


def sentence_label(out: Column) -> Column:
    """Keep ``@k`` labels only."""
    return F.when(out.startswith("@"), out).otherwise("<eps>")


def dictionary_label(label: Column) -> Column:
    """``D=k`` as -k - 100, other labels null."""
    return F.when(label.startswith("D="), -F.substring(label, 3, 20).try_cast("int") - 100)


def quantise(x: Column, scale: float) -> Column:
    """floor(x * scale + 0.5)."""
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("long")


def quantise_down(x: Column, scale: float) -> Column:
    """x * scale cut towards zero."""
    return (x * F.lit(scale)).cast("long")


def rate(errors_free: Column, total: Column) -> Column:
    """A percentage with two decimals; 0 where the total is not positive."""
    return F.coalesce(F.round(F.when(total > 0, F.lit(100.0) * errors_free / total), 2), F.lit(0.0))


def real_time_factor(seconds: Column, frames: Column) -> Column:
    return F.try_divide(seconds * 100, frames)


def toggle_comment(line: Column, mode: str) -> Column:
    """Comment lines marked for one arithmetic, uncomment those for the other."""
    on, off = ("@fixed", "@float") if mode == "fixed" else ("@float", "@fixed")
    bare = F.regexp_replace(line, r"^\s*//", "")
    return F.when(line.contains(off), F.concat(F.lit("//"), bare)).when(line.contains(on), bare).otherwise(line)


def with_prefix(path: Column, prefix: str) -> Column:
    """A path below a folder."""
    return F.concat(F.lit(prefix.rstrip("/") + "/"), path)


def width(token: Column) -> Column:
    """Columns that a token takes on a screen: two a character where it is not pure ASCII."""
    return F.when(is_ascii(token), F.char_length(token)).otherwise(2 * F.char_length(token))


def padded(op: Column, own: Column, other: Column) -> Column:
    """A token of an aligned pair as wide as its partner; blanks where it has none."""
    lack = F.greatest(F.lit(0), width(other) - width(own))
    return F.when(own.isNull(), F.repeat(F.lit(" "), width(other))).when(op == "S", F.concat(F.repeat(F.lit(" "), lack), own)).otherwise(own)


def checked_quantise(x: Column, scale: float, lo: int = -32768, hi: int = 32767) -> Column:
    """quantise(); a value outside lo .. hi is an error."""
    q = quantise(x, scale)
    return F.when(q.between(lo, hi) | q.isNull(), q).otherwise(F.raise_error(F.concat(F.lit("value out of range: "), q.cast("string"))).cast("long"))


def without_zeros(x: Column) -> Column:
    return F.filter(x, lambda v: v != 0)


def mixture_log(weight: Column) -> Column:
    """ln of a mixture weight; -1e10 below 1e-5."""
    return F.when(weight < 1e-5, F.lit(-1e10)).otherwise(F.ln(weight))


def transition_log(p: Column) -> Column:
    """ln of a transition probability; 0 stays 0."""
    return F.when(p == 0, F.lit(0.0)).otherwise(F.ln(p))


def frame_count(values: Column, dim: int) -> Column:
    """Frames in a file of one header value and dim values a frame."""
    return F.floor((values - 1) / dim).cast("int")


def decode_options(beam: int, alpha: float) -> tuple[int, float]:
    """Beam and scale of the language model within their limits."""
    if not 0 < beam <= 300_000:
        raise ValueError("the beam is at most 300000")
    if not 0 <= alpha <= 1000:
        raise ValueError("the scale is at most 1000")
    return beam, alpha
