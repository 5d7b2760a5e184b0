"""Structural sketches of source files.

A file becomes the sequence of its syntax: keywords and punctuation as they
are, every name, number and string as one token each, no comments and no white
space.  Hashes of all runs of ``GRAM`` tokens are thinned by taking the least of
every ``WINDOW`` neighbours.  One Arrow UDF does all of it per file, since the
lexer keeps state.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

# --- fixed values -----------------------------------------------------------
_KEYWORDS = frozenset(
    """
    async await break case catch class const continue debugger default delete do
    else export extends finally for function if import in instanceof let new of
    return static super switch this throw try typeof var void while with yield
    and as assert def del elif except from global is lambda nonlocal not or pass
    raise
    true false null undefined none True False None
    """.split()
)
_BEFORE_REGEX = frozenset(
    "( , = : [ ! & | ? { } ; + - * % < > ~ ^ => === !== == != && || "
    "return typeof instanceof in of new delete void throw case do else yield await".split()
) | {""}
_MARKS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> := "
    "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"
).split()
_NUMBER = r"0[xXbBoO][0-9a-fA-F_]+n?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[njJ]?|\.\d[\d_]*"
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
# --- end of fixed values ----------------------------------------------------

_MARK = "|".join(re.escape(m) for m in sorted(_MARKS, key=len, reverse=True))
_COMMENT = {"js": r"//[^\n]*\n?|/\*[\s\S]*?(?:\*/|\Z)", "py": r"\#[^\n]*\n?"}
_QUOTED = {
    "js": r'"(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z)' + r"|'(?:\\[\s\S]|[^'\\])*(?:'|\\?\Z)",
    "py": r'"""[\s\S]*?(?:"""|\Z)' + r"|'''[\s\S]*?(?:'''|\Z)|```[\s\S]*?(?:```|\Z)" + r'|"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\\?\Z)' + r"|'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\\?\Z)|`(?:\\[\s\S]|[^`\\\n])*(?:`|(?=\n)|\\?\Z)",
}
_REGEX_LITERAL = re.compile(r"/(?:\\[\s\S]|\[(?:\\[\s\S]|[^\]\\\n])*\]|[^/\\\[\n])*/[^\W\d_]*")
#: What the lexer reads next, first alternative first; back-quoted templates and regular expressions need its state.
_LEXERS = {
    lang: re.compile(rf"(?P<comment>{_COMMENT[lang]})|(?P<quoted>{_QUOTED[lang]})|(?P<number>{_NUMBER})|(?P<name>{_NAME})|(?P<mark>{_MARK})")
    for lang in ("js", "py")
}
_PRIME = np.uint64(fixed.PRINT_PRIME)
_TEMPLATE_PART = re.compile(r"\\[\s\S]?|\$\{|[`}\"']|[^\\$`}\"']+|\$")


def _template_end(text: str, start: int) -> int:
    """Where the template that begins at ``start`` ends; strings inside its expressions are skipped whole."""
    at, depth = start + 1, 0
    quoted = _LEXERS["js"]
    while (part := _TEMPLATE_PART.match(text, at)) is not None:
        found = part.group()
        if found == "`" and not depth:
            return part.end()
        if found in ("`", '"', "'") and depth:
            at = _template_end(text, at) if found == "`" else quoted.match(text, at).end()
            continue
        depth += (found == "${") - (found == "}" and depth > 0)
        at = part.end()
    return len(text)


def syntax_tokens(text: str, lang: str) -> list[str]:
    """The tokens of a source file; ``lang`` is ``js`` or ``py``."""
    lexer, out, at, n = _LEXERS[lang], [], 0, len(text)
    while at < n:
        if lang == "js" and text[at] == "`":
            at = _template_end(text, at)
            out.append("str")
            continue
        if lang == "js" and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (out[-1] if out else "") in _BEFORE_REGEX:
            literal = _REGEX_LITERAL.match(text, at)
            if literal:
                at = literal.end()
                out.append("str")
                continue
        found = lexer.match(text, at)
        if found is None:
            at += 1
            continue
        at = max(found.end(), at + 1)
        kind = found.lastgroup
        if kind == "quoted":
            out.append("str")
        elif kind == "number":
            out.append("num")
        elif kind == "name":
            out.append(found.group() if found.group() in _KEYWORDS else "id")
        elif kind == "mark":
            out.append(found.group())
    return out


def token_hash(token: str) -> int:
    """48 bits of a token's digest."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=6).digest(), "big")


def _times_base_plus(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``hashes * BASE + values`` modulo the Mersenne prime, without a product beyond 64 bits.

    A hash is cut into its upper 30 and lower 31 bits.  The upper product stands
    31 bits higher, so what of it lies beyond bit 61 comes back at bit 0.
    """
    upper, lower = (hashes >> np.uint64(31)) * np.uint64(fixed.PRINT_BASE), (hashes & np.uint64((1 << 31) - 1)) * np.uint64(fixed.PRINT_BASE)
    total = (upper >> np.uint64(30)) + ((upper & np.uint64((1 << 30) - 1)) << np.uint64(31)) + lower + values
    total = (total & _PRIME) + (total >> np.uint64(61))
    return np.where(total >= _PRIME, total - _PRIME, total)


def gram_hashes(tokens: list[str], gram: int = fixed.GRAM) -> np.ndarray:
    """Of every run of ``gram`` tokens, the value of its tokens' digests as digits to the base, modulo the prime: all runs at once."""
    if len(tokens) < gram:
        return np.zeros(0, np.int64)
    known = {t: token_hash(t) for t in set(tokens)}
    values = np.array([known[t] for t in tokens], dtype=np.uint64)
    n = len(tokens) - gram + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        hashes = _times_base_plus(hashes, values[k : k + n])
    return hashes.astype(np.int64)


def winnow(hashes: np.ndarray, window: int = fixed.WINDOW) -> list[int]:
    """The distinct minima of every ``window`` neighbours, sorted; of a shorter sequence the first hash."""
    if len(hashes) <= window:
        return [int(h) for h in hashes[:1]]
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1)).tolist()


def sketch(text: str | None, lang: str | None) -> list[int] | None:
    """A file's prints; null if the file is too short to say anything."""
    if text is None or lang is None:
        return None
    tokens = syntax_tokens(text, lang)
    if len(tokens) < fixed.LEAST_TOKENS:
        return None
    prints = winnow(gram_hashes(tokens))
    return prints if len(prints) >= fixed.LEAST_PRINTS else None


def label(prints: list[int] | np.ndarray | None) -> str | None:
    """A short name of a set of prints: a digest of the sorted prints, eight bytes each, the highest first."""
    if prints is None or not len(prints):
        return None
    return hashlib.blake2b(np.sort(np.asarray(prints, dtype=np.int64)).astype(">u8").tobytes(), digest_size=8).hexdigest()


@F.pandas_udf(T.StringType())
def label_of(prints: pd.Series) -> pd.Series:
    """Arrow-batched ``label``."""
    return prints.map(label, na_action=None)


@F.pandas_udf(T.ArrayType(T.LongType()))
def prints_of(text: pd.Series, lang: pd.Series) -> pd.Series:
    """Arrow-batched ``sketch``."""
    return pd.Series([sketch(t, s) for t, s in zip(text, lang)], dtype=object)


def language_of(path):
    """``js`` or ``py`` by a path's suffix, else null."""
    out = F.lit(None).cast("string")
    for suffix, lang in fixed.LANGUAGES.items():
        out = F.when(path.endswith(suffix), F.lit(lang)).otherwise(out)
    return out
