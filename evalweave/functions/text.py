"""Column functions on text, names, numbers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation characters.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Model-name prefixes and their families, tested in this order.
MODEL_FAMILIES = (
    ("gpt", "gpt"),
    ("claude", "claude"),
    ("gemini", "gemini"),
    ("gemma", "gemma"),
    ("llama", "llama"),
    ("mistral", "mistral"),
    ("command", "cohere"),
    ("qwen", "qwen"),
    ("deepseek", "deepseek"),
    ("glm", "glm"),
    ("mimo", "mimo"),
    ("lfm", "lfm"),
    ("minimax", "minimax"),
    ("kimi", "kimi"),
    ("grok", "grok"),
)

UNKNOWN_FAMILY = "__unknown__"

# Fixed value: marks the outputs of smoke tests.
SMOKE_TEST = "one_entry_test"

# Fixed value: the effort named in run names when reasoning is on without an effort.
DEFAULT_EFFORT = "high"

_SPACE = r"[\s\x1c-\x1f]"

# Found in a text that ``strip`` does not empty.
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks as ``trim`` does."""
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def text_key(c: Column | str) -> Column:
    """Trimmed lower-case text, the key under which equal texts meet. NULL counts as empty."""
    return F.lower(strip(F.coalesce(_col(c), F.lit(""))))


def pair_key(first: Column | str, second: Column | str) -> Column:
    """Struct of two text keys, NULL unless both are non-empty, so that it never joins then."""
    a, b = text_key(first), text_key(second)
    return F.when((a != "") & (b != ""), F.struct(a.alias("a"), b.alias("b")))


def comparison_text(c: Column | str) -> Column:
    """Lower-case text without ASCII punctuation and with single blanks, for similarity."""
    bare = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, rf"(?U){_SPACE}+", " "))


def safe_name(c: Column | str) -> Column:
    """A model name usable in a file name."""
    return F.translate(_col(c), "/\\:", "___")


def without_org(c: Column | str) -> Column:
    """Text after the first slash, or all of it."""
    c = _col(c)
    return F.substring(c, F.instr(c, "/") + 1, F.length(c))


def model_family(c: Column | str) -> Column:
    """Family of a model id: first matching prefix, else the bare id, else unknown."""
    raw = text_key(c)
    name = without_org(raw)
    family = F.when(raw == "", F.lit(UNKNOWN_FAMILY))
    for prefix, label in MODEL_FAMILIES:
        family = family.when(name.startswith(prefix), F.lit(label))
    return family.otherwise(name)


def solver_parts(c: Column | str) -> Column:
    """``provider:model`` as a struct; the model is NULL when absent or blank."""
    parts = F.split(_col(c), ":", 2)
    return F.struct(
        strip(parts[0]).alias("provider"),
        F.nullif(strip(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("model"),
    )


def numbered_id(prefix: str, n: Column) -> Column:
    """``prefix`` plus at least four digits."""
    return F.format_string(prefix + "%04d", n)


def id_number(c: Column | str, prefix: str = "alt_") -> Column:
    """The number of an id that starts with ``prefix`` and digits, else NULL."""
    return F.expr(
        f"try_cast(nullif(regexp_extract({_name(c)}, '^{prefix}([0-9]+)', 1), '') AS BIGINT)"
    )


def _name(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("give the column by name")
    return f"`{c}`"


def reasoning_label(enabled: Column | str, effort: Column | str) -> Column:
    """The effort, or on/off where no effort is set."""
    return F.coalesce(
        F.nullif(_col(effort), F.lit("")),
        F.when(F.coalesce(_col(enabled), F.lit(False)), F.lit("on")).otherwise(F.lit("off")),
    )


def model_key(model: Column | str, enabled: Column | str, effort: Column | str) -> Column:
    return F.concat_ws("|", _col(model), reasoning_label(enabled, effort))


def run_name(
    model: Column | str,
    temperature: Column | str,
    enabled: Column | str,
    effort: Column | str,
    smoke_test: bool = False,
) -> Column:
    """Name of a run's output: model, temperature if above zero, reasoning tag."""
    temperature = _col(temperature)
    return F.concat(
        F.lower(safe_name(model)),
        F.when(temperature > 0, F.concat(F.lit("_temp"), temperature.cast("string"))).otherwise(""),
        F.when(
            F.coalesce(_col(enabled), F.lit(False)),
            F.concat(
                F.lit("_reasoning-"),
                F.coalesce(F.nullif(_col(effort), F.lit("")), F.lit(DEFAULT_EFFORT)),
            ),
        ).otherwise(""),
        F.lit("_" + SMOKE_TEST if smoke_test else ""),
    )


def preview(c: Column | str, size: int = 55) -> Column:
    """The first ``size`` characters, with dots where something was cut (display only)."""
    c = _col(c)
    return F.concat(F.left(c, F.lit(size)), F.when(F.length(c) > size, "...").otherwise(""))


def percent(c: Column | str) -> Column:
    return F.concat(F.format_string("%.1f", fixed_digits(_col(c) * 100, 1)), F.lit("%"))


def plus_minus(c: Column | str) -> Column:
    return F.concat(F.lit("+/-"), percent(c))


def fixed_digits(c: Column, digits: int) -> Column:
    """Display rounding, ties decided by the exact binary value.

    Only a value whose shortest decimal form is a tie can be one. It is compared with the tie
    ``(2 f + 1) / (2 * 10**digits)`` without loss: its part above 2**-20 and the rest are
    multiplied and subtracted exactly, and a sum of two doubles has the sign of the exact one.
    Values outside [2**-15, 2**33) keep the shortest form's half-even rule.
    """
    x = c.cast("double")
    scale = 10**digits
    shortest = x.cast("decimal(38,18)") * scale
    below = F.floor(shortest).cast("long")
    is_tie = (x >= 2.0**-15) & (x < 2.0**33) & (shortest - below == F.lit(0.5).cast("decimal(2,1)"))
    high = F.floor(x * 2.0**20) / F.lit(2.0**20)
    side = (high * F.lit(2.0 * scale) - (below * 2 + 1)) + (x - high) * F.lit(2.0 * scale)
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(below % 2)
    return F.when(is_tie, (below + up) / F.lit(float(scale))).otherwise(F.bround(x, digits))


def round4(c: Column | str) -> Column:
    """Four decimals, ties decided by the exact binary value as in IEEE-correct rounding.

    ``bround`` decides a tie on the shortest decimal form, where 0.00005 is a tie although
    its binary value lies above it. Only such ties, inside (0, 1), are compared exactly:
    ``x`` times a power of two is an integer that fits BIGINT, so the comparison is done in
    DECIMAL without loss.
    """
    x = _col(c).cast("double")
    shortest = x.cast("decimal(38,20)")
    is_tie = (x > 0) & (x < 1) & (F.pmod(shortest * 100000, F.lit(10)) == 5)
    floor4 = F.floor(shortest * 10000).cast("long")

    def above(power: int) -> Column:
        exact = (x * F.lit(float(2**power))).cast("long").cast("decimal(19,0)") * F.lit(20000)
        # 2**power / 2**62 is a power of two of at most 32 here, kept on the decimal side.
        tie = (2 * floor4 + 1).cast("decimal(12,0)") * F.lit(2**62).cast("decimal(19,0)")
        if power > 62:
            tie = tie * F.lit(2 ** (power - 62))
        return F.signum((exact - tie).cast("decimal(38,0)"))

    side = F.when(x >= 2.0**-9, above(62)).otherwise(above(67))
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(floor4 % 2)
    return F.when(is_tie, ((floor4 + up) / F.lit(10000.0))).otherwise(F.bround(x, 4))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 where the denominator is zero or NULL."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def steady_mean(c: Column) -> Column:
    """Mean in steps of 1e-12 per value, NULL without values.

    A sum of doubles depends on the order of the rows, hence on partitioning and retries,
    and a last-digit difference decides rounding ties. Decimal sums do not.
    """
    return F.try_divide(F.sum(c.cast("decimal(28,12)")).cast("double"), F.count(c))


def _utc(ts: Column | None) -> Column:
    """``ts`` as wall-clock UTC, whatever the session time zone is."""
    ts = F.current_timestamp() if ts is None else ts
    return F.to_utc_timestamp(ts, F.current_timezone())


def record_time(ts: Column | None = None) -> Column:
    return F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss")


def snapshot_time(ts: Column | None = None) -> Column:
    return F.date_format(_utc(ts), "yyyyMMdd_HHmmss")


def report_time(ts: Column | None = None) -> Column:
    return F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
