"""SQL expression builders over one text column, for use in ``F.expr``."""

from __future__ import annotations

import re
from re import _constants as rc
from re import _parser as rp

from pkgscreen import vocab as v


def sq(text: str) -> str:
    """A raw SQL string literal."""
    return "r'" + text + "'"


def has(pattern: str, col: str = "text", cs: bool = False) -> str:
    return f"({col} RLIKE {sq(('' if cs else '(?i)') + pattern)})"


def pick(pattern: str, group: int = 1, col: str = "text", cs: bool = False) -> str:
    """The first match, NULL when there is none."""
    return f"get(regexp_extract_all({col}, {sq(('' if cs else '(?i)') + pattern)}, {group}), 0)"


def _best(found: list[list[str]]) -> list[str]:
    """Of several sets of which any match holds a word each, that with the longest shortest word."""
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=[])


def _words_of(tokens) -> list[str]:
    run, found = "", []
    for op, arg in [*tokens, (None, None)]:
        if op is rc.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            found.append([run])
        run, inner = "", []
        if op is rc.SUBPATTERN:
            inner = _words_of(arg[3])
        elif op is rc.MAX_REPEAT and arg[0] > 0:
            inner = _words_of(arg[2])
        elif op is rc.BRANCH:
            every = [_words_of(branch) for branch in arg[1]]
            inner = [w for words in every for w in words] if all(every) else []
        if inner:
            found.append(inner)
    return _best(found)


def needed(pattern: str) -> list[str]:
    """Lower-case words of which every match of a pattern holds one; none if that cannot be told."""
    words = list(dict.fromkeys(_words_of(rp.parse(re.sub(r"\\p\{\w+\}", r"\\w", pattern)))))
    plain = all(len(w) > 1 and re.fullmatch(r"[a-z0-9 @./(%-]+", w) for w in words)
    return words if plain and len(words) <= 40 else []


def may_hold(pattern: str, lowered: str) -> str:
    """A cheap test that no text can fail in which the pattern is found, whatever its case; most labels fail most of them."""
    return mentions(needed(pattern), lowered) if needed(pattern) else "true"


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words anywhere."""
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words)


def mentions(words: list[str], lowered: str) -> str:
    """Whether a lower-case text holds any of the words, anywhere."""
    return "(" + " OR ".join(f"contains({lowered}, '{w}')" for w in words) + ")"


def strip(col: str = "text") -> str:
    return f"trim(BOTH '{v.WS_CHARS}' FROM {col})"


def strip_of(col: str, chars: str) -> str:
    return f"trim(BOTH '{chars}' FROM {col})"


def in_list(col: str, words: list[str]) -> str:
    return f"({col} IN ({', '.join(repr(w) for w in words)}))"


def letters_share(col: str) -> str:
    return (f"(length(regexp_replace({col}, {sq('[^' + chr(92) + 'p{L}]')}, '')) "
            f"/ greatest(1, length(replace({col}, ' ', ''))))")


def no_trademark(col: str) -> str:
    return strip_of(strip(f"regexp_replace({col}, {sq(v.TRADEMARK_CS)}, '')"), " :-–—.,")


def title_or_upper(col: str) -> str:
    upper = f"({col} = upper({col}) AND {col} <> lower({col}))"
    title = f"(NOT {has(r'(^|[^\p{L}])\p{Ll}', col, True)} AND NOT {has(r'\p{L}\p{Lu}', col, True)})"
    return f"({upper} OR {title})"


def words(col: str):
    """Lower-case word tokens of a text, in order."""
    return f"regexp_extract_all(lower({col}), {sq(v.WORD_TOKEN)}, 0)"


def reg_tokens(col: str):
    """Regulation tokens: lower-case letters and digits without stop words."""
    return (f"filter(regexp_extract_all(lower({col}), {sq(v.REG_TOKEN)}, 0), "
            f"t -> NOT {in_list('t', v.REG_STOPWORDS)})")


def one_spaced(col: str) -> str:
    return f"trim(regexp_replace({col}, {sq(v.WS + '+')}, ' '))"
