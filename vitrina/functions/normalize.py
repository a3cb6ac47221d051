"""Title normalisation as one native column expression (no UDF).

A rule set is an ordered list of ``(java regex, replacement)`` pairs applied to the lower-cased,
accent-free title. The versions differ in boundaries, units and clean-up rules:

* ``v4``  current rules: units, number masking, ``&``, ``%``, punctuation, boilerplate phrases
* ``v4_sheet``  like ``v4``, but ``20/30`` keeps its slash and boilerplate stays
* ``v3``  narrower boundaries, no ``a/b`` rule, a lone slash becomes a space
* ``v2``  five units, numbers replaced with a trailing space
* ``v1``  five units only; the spaces around a measure are swallowed
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.tokens import bind

Rule = tuple[str, str]


@functools.cache
def accent_table() -> tuple[str, str]:
    """Every non-ASCII character whose canonical decomposition starts from one ASCII character."""
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.decomposition(char) and not unicodedata.decomposition(char).startswith("<"):
            ascii_part = [c for c in unicodedata.normalize("NFD", char) if ord(c) < 128]
            if len(ascii_part) == 1:
                source.append(char)
                target.append(ascii_part[0])
    return "".join(source), "".join(target)


def strip_accents(col: Column) -> Column:
    """Canonical decomposition followed by the removal of everything outside ASCII."""
    source, target = accent_table()
    return F.regexp_replace(F.translate(col, source, target), r"[^\p{ASCII}]", "")


def java_trim(col: Column) -> Column:
    """Trim every character up to U+0020 from both ends, not only spaces.

    In front of a line terminator outside ASCII that ends the text, too: ``$`` matches there.
    """
    ends = [F.endswith(col, F.lit(c)) for c in LINE_ENDS]
    by_rule = F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.when(ends[0] | ends[1] | ends[2], by_rule).otherwise(F.btrim(col, F.lit(CONTROLS)))


CONTROLS = "".join(map(chr, range(0x21)))
LINE_ENDS = ("\u0085", "\u2028", "\u2029")

# Unit spellings and the word they become, boundaries, phrases.
INCH_MARKS = ("'", "''", '"')
UNITS = (
    # spellings, word, may follow an "x" as in 20x40cm
    (("mm", "milimetro", "milimetros"), "milimetros", True),
    (("cm", "centimetros", "centimetro"), "centimetros", True),
    (("m", "metro", "metros"), "metros", True),
    (("lts", "l", "litros", "litro"), "litros", False),
    (("ml", "mililitros", "mililitro"), "mililitros", True),
    (("gr", "grs", "gramos", "gramo"), "gramos", False),  # never "g": 4g phones
    (("kilo", "kilos"), "kilogramos", False),  # never "k": 4k televisions
    (("w", "watt", "watts"), "watts", False),
    (("v", "volt", "volts"), "volts", False),
)
OLD_UNITS = (
    (("mm",), "milimetros"),
    (("cm",), "centimetros"),
    (("m",), "metros"),
    (("lts", "l"), "litros"),
)
BOILERPLATE = ("envio gratis", "local a la calle", "factura a o b", "factura a", "factura b")
KEPT = string.ascii_letters + string.digits + string.whitespace + "_+'\"/"
# Punctuation rule: every other ASCII character becomes a space. A character map, not a regex.
PUNCTUATION = "".join(c for c in map(chr, range(128)) if c not in KEPT)

WIDE_LEFT = (r"\s", r"\(", r"\[", r"\:")
WIDE_RIGHT = (r"\s", r"\.$", r"\.\s", "%", "!", "°", r"\)", r"\]")
NARROW_LEFT = (r"\s",)
NARROW_INCH_RIGHT = (r"\s", r"\.$", r"\.\s")
NARROW_RIGHT = (*NARROW_INCH_RIGHT, "!", "%")

LITERALS = {"&", "%", *BOILERPLATE}


def _after(*starts: str) -> str:
    """Left boundary of a number. The digit is tested first, so that the costlier look-behind runs
    only where a number may start."""
    return r"(?=\d)(?<=^|" + "|".join(starts) + ")"


def _ends(*ends: str) -> str:
    return "($|" + "|".join(ends) + ")"


def _before(*ends: str) -> str:
    return "(?=$|" + "|".join(ends) + ")"


def _measures(left: tuple[str, ...], right: tuple[str, ...], inch_right: tuple[str, ...]) -> list[Rule]:
    rules = [(rf"{_after(*left)}(\d+)({'|'.join(INCH_MARKS)}){_ends(*inch_right)}", "$1 pulgadas$3")]
    for spellings, word, after_x in UNITS:
        start = _after(*left, "x") if after_x else _after(*left)
        rules.append((rf"{start}(\d+) ?({'|'.join(spellings)}){_ends(*right)}", f"$1 {word}$3"))
    return rules


def _masks(left: tuple[str, ...], right: tuple[str, ...], slash: str | None) -> list[Rule]:
    stop = _before(*right, r",\s")
    rules: list[Rule] = []
    if slash:
        rules.append((rf"{_after(*left)}\d+/\d+{stop}", f"NUMBER {slash} NUMBER"))
    return [
        *rules,
        (rf"{_after(*left)}\d+x\d+{stop}", "NUMBER x NUMBER"),
        (rf"{_after(*left, ',', r'\.')}\d+{_before(*right, ',')}", "NUMBER"),
        (rf"{_after(*left)}(\d+|\d+\.\d+|\d+,\d+){stop}", "NUMBER"),
    ]


def _v4(slash: str, phrases: tuple[str, ...]) -> list[Rule]:
    return [
        *_measures(WIDE_LEFT, WIDE_RIGHT, WIDE_RIGHT),
        *_masks(WIDE_LEFT, WIDE_RIGHT, slash),
        ("&", " y "),
        ("%", " porciento "),
        (PUNCTUATION, " "),
        (r"\s+", " "),
        *((phrase, "") for phrase in phrases),
    ]


def _v3() -> list[Rule]:
    return [
        *_measures(NARROW_LEFT, NARROW_RIGHT, NARROW_INCH_RIGHT),
        *_masks(NARROW_LEFT, NARROW_RIGHT, None),
        ("&", " y "),
        ("%", " porciento "),
        (PUNCTUATION, " "),
        (r"\s/\s", " "),
        (r"\s+", " "),
    ]


def _v2() -> list[Rule]:
    left = _after(*NARROW_LEFT)
    rules = [(rf"{left}(\d+)(''|\")($|\s)", "$1 pulgadas$3")]
    for spellings, word in OLD_UNITS:
        space = r"\s" if word == "litros" else " "
        rules.append((rf"{left}(\d+) ?(?:{'|'.join(spellings)})($|{space})", f"$1 {word}$2"))
    return [
        *rules,
        (rf"{left}(?:\d+|\d+\.\d+|\d+,\d+){_ends(*NARROW_INCH_RIGHT, r',\s')}", "NUMBER $1"),
        (PUNCTUATION, " "),
        (r"\s/\s", " "),
        (r"\s+", " "),
    ]


def _v1() -> list[Rule]:
    rules = [(r"(?:^| )(\d+)(?:''|\")", "$1 pulgadas")]
    for spellings, word in OLD_UNITS:
        rules.append((rf"(?:^| )(\d+) ?(?:{'|'.join(spellings)})(?:$| )", f"$1 {word}"))
    return rules


RULE_SETS: dict[str, list[Rule]] = {
    "v4": _v4("x", BOILERPLATE),
    "v4_sheet": _v4("/", ()),
    "v3": _v3(),
    "v2": _v2(),
    "v1": _v1(),
}


def _apply(col: Column, rules: list[Rule]) -> Column:
    for pattern, replacement in rules:
        if pattern == PUNCTUATION:
            col = F.translate(col, PUNCTUATION, " " * len(PUNCTUATION))
        elif pattern in LITERALS:
            col = F.replace(col, F.lit(pattern), F.lit(replacement))
        else:
            col = F.regexp_replace(col, F.lit(pattern), F.lit(replacement))
    return col


def _where(guard: str, rules: list[Rule], col: Column) -> Column:
    """The rules for texts in which ``guard`` is found; no rule can match in another text.

    A search costs as much as a rule, so texts without a measure are spared one search per unit.
    """
    return bind(col, lambda c: F.when(c.rlike(guard), _apply(c, rules)).otherwise(c))


# Searches for what every rule of a group needs in front of the first of them.
SOME_MEASURE = rf"\d ?(?:{'|'.join(sorted({u for names, _, _ in UNITS for u in names} | set(INCH_MARKS)))}){_before(*WIDE_RIGHT)}"
SOME_PAIR = r"\d[/x]\d"


def normalize_title(title: Column | str, version: str = "v4") -> Column:
    """Normalised title under the named rule set."""
    col = F.col(title) if isinstance(title, str) else title
    col = F.lower(col)
    if version != "v1":
        col = java_trim(col)
    col = strip_accents(col)
    rules = RULE_SETS[version]
    if version.startswith("v4"):
        units, masks = len(UNITS) + 1, len(UNITS) + 3
        col = _where(SOME_MEASURE, rules[:units], col)
        col = _where(SOME_PAIR, rules[units:masks], col)
        rules = rules[masks:]
    return _apply(col, rules)
