"""Column functions over text: tokens, predicates on lines, levels, entropy, classes.

Blanks are the five ASCII ones below; `\\s` is avoided because engines differ on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks, and patterns of the line formats.
BLANKS = r"[ \t\n\f\r]"
ONLY_BLANKS = r"^[ \t\n\f\r]*\z"
COMMON_LOG = r'^\S+[ \t]+\S+[ \t]+\S+[ \t]+\[[0-9A-Za-z_:/]+[ \t][+\-][0-9]{4}\][ \t]+".+?"[ \t]+[0-9]{3}[ \t]+([0-9]+|-)\z'
PAIR = r'(^|[ \t])[^ \t="]+=("[^"]*"|[^ \t"]+)'
TIME_PREFIX = r"^[0-9]{4}[-/T.]"

#: Words that show a level in a line, and the spellings of each level, least severe first.
LEVEL_WORDS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "trace", "debug", "info", "warn", "warning", "error", "fatal", "critical"]
LEVELS = {
    "TRACE": ["TRACE", "trace", "TRC"],
    "DEBUG": ["DEBUG", "debug", "DBG"],
    "INFO": ["INFO", "info", "INF"],
    "WARN": ["WARN", "warn", "WRN", "WARNING", "warning"],
    "ERROR": ["ERROR", "error", "ERR"],
    "FATAL": ["FATAL", "fatal", "CRIT", "crit", "CRITICAL"],
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(message: Column | str) -> Column:
    """Words between blanks, empty ones dropped."""
    return F.filter(F.split(_col(message), BLANKS + "+"), lambda t: t != "")


def word_count(message: Column | str) -> Column:
    return F.size(tokens(message))


def indent(line: Column | str) -> Column:
    """Number of leading blanks."""
    return F.length(_col(line)) - F.length(F.regexp_replace(_col(line), f"^{BLANKS}+", ""))


def is_blank(line: Column | str) -> Column:
    return F.regexp_like(_col(line), F.lit(ONLY_BLANKS))


def is_json(line: Column | str) -> Column:
    """Any JSON value.  Only what begins and ends like one is parsed; the end also makes up for the parser's tolerance of trailing text."""
    ends = F.regexp_like(_col(line), F.lit(r'^[ \t\n\f\r]*[{\["0-9tfn-]')) & F.regexp_like(_col(line), F.lit(r'[}\]"0-9a-z][ \t\n\f\r]*\z'))
    return ends & F.try_parse_json(_col(line)).isNotNull()


def is_logfmt(line: Column | str, compat: bool = False) -> Column:
    """At least one key=value pair; `compat` keeps the rule by which no line qualifies."""
    return F.lit(False) if compat else F.regexp_like(_col(line), F.lit(PAIR))


def is_common_log(line: Column | str) -> Column:
    return F.regexp_like(_col(line), F.lit(COMMON_LOG))


def is_syslog(line: Column | str) -> Column:
    """A priority of one to three digits, at most 191, in angle brackets."""
    pri = F.regexp_extract(_col(line), "^<([0-9]{1,3})>", 1)
    return (pri != "") & (F.coalesce(pri.try_cast("int"), F.lit(999)) <= 191)


def has_time_prefix(text: Column | str) -> Column:
    return F.regexp_like(_col(text), F.lit(TIME_PREFIX))


def has_level(text: Column | str) -> Column:
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, LEVEL_WORDS)))


def level(word: Column | str) -> Column:
    """The level that a word spells, or null."""
    spelled = F.create_map(*[F.lit(x) for name, words in LEVELS.items() for w in words for x in (w, name)])
    return F.try_element_at(spelled, _col(word))


def level_rank(name: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), _col(name))


def similarity(words: Column | str, template: Column | str) -> Column:
    """Share of positions that agree; null in the template agrees with any word."""
    a, b = _col(words), _col(template)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: y.isNull() | F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(same / F.size(a))


def generalise(words: Column | str, template: Column | str) -> Column:
    """Words on which both agree, null elsewhere; null stays null."""
    return F.zip_with(_col(words), _col(template), lambda x, y: F.when(x == y, x))


def render(template: Column | str) -> Column:
    return F.array_join(_col(template), " ", "*")


def wildcards(template: Column | str) -> Column:
    return F.size(F.filter(_col(template), lambda x: x.isNull()))


def template_id(template: Column | str) -> Column:
    """A 60-bit id of the token sequence in which a wildcard differs from the word `*`."""
    marked = F.array_join(F.transform(_col(template), lambda t: F.coalesce(F.concat(F.lit("L"), t), F.lit("W"))), " ")
    return F.conv(F.substring(F.md5(marked), 1, 15), 16, 10).cast("long")


def is_opaque(text: Column | str) -> Column:
    """Has a control character other than tab, line feed and return, or anything above the printable ASCII."""
    return F.regexp_like(_col(text), F.lit(r"[^\x20-\x7E\t\n\r]"))


def entropy(text: Column | str) -> Column:
    """Shannon bits per byte, from one histogram of each text; characters of ASCII text are bytes."""

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> float | None:
            if x is None:
                return None
            counts = np.bincount(np.frombuffer(x.encode("utf-8", "replace"), dtype=np.uint8))
            shares = counts[counts > 0] / max(1, counts.sum())
            return float(-(shares * np.log2(shares)).sum()) + 0.0

        return texts.map(one)

    return bits(_col(text))


#: Bits per byte above which text counts as dense, least bytes and words of a message.
DENSE, MESSAGE_BYTES, MESSAGE_WORDS = 3.5, 60, 5


def entropy_class(text: Column | str) -> Column:
    return F.when(is_opaque(text), "opaque").when(entropy(text) > DENSE, "high").otherwise("low")


def text_class(text: Column | str, threshold: float = DENSE) -> Column:
    """scalar, multiline or line; thresholds below the fixed one have no effect."""
    s = _col(text)
    short = (F.octet_length(s) < MESSAGE_BYTES) | ~F.contains(s, F.lit(" "))
    dense = is_opaque(s) | (entropy(s) > max(DENSE, threshold))
    message = has_time_prefix(s) | has_level(s) | (word_count(s) >= MESSAGE_WORDS)
    return F.when(short, "scalar").when(F.contains(s, F.lit("\n")), "multiline").when(dense, "scalar").when(message, "line").otherwise("scalar")


def token_estimate(text: Column | str, bytes_per_token: float = 4.0) -> Column:
    return F.floor(F.octet_length(_col(text)) / bytes_per_token).cast("long")


def key_tier(seen: Column | str, total: Column | str) -> Column:
    share = _col(seen) / _col(total)
    return F.when(_col(total) == 0, "common").when(share > 0.8, "common").when(share >= 0.2, "partial").otherwise("polymorphic")
