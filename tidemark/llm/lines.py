"""What a line of a mail is, and counts over pieces of text that add up.

Pure Python without Spark. A paragraph's plain lines are judged together, by the share of
frequent words in them, as a wrapped line says little by itself.
"""

from __future__ import annotations

import re

#: Fewer words than these without a frequent one are a greeting, a name or a caption, not junk.
FEW_WORDS = 9
FEW_SIGNS = 12
#: In a paragraph of fewer words a single frequent one tells that it is spoken.
SHORT = 24
LEAST_COMMON = 0.1
LEAST_KANA = 0.12
LONGEST_SENTENCE = 20

_ITEM = re.compile(r"\s*(?:[-*•–—+◦‣▪·]|\[[ xX✓]?\]|[☐☑☒✓✔]|\(?\d{1,4}[.)]|#\d+|\(?[a-zA-Z]\))\s+\S|\s+o\s+\S|\s*\d{1,6} ?[x×] \S")
_MACHINE = re.compile(
    r"\s*(?:at \S+\(|Traceback\b|File \"|Caused by:|Exception\b|\w+(?:\.\w+)+(?:Error|Exception)\b"
    r"|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\w{3} +\d{1,2} \d\d:\d\d:\d\d |\w+://\S+\s*$|0x[0-9a-fA-F]+\b"
    r"|[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,8}\s+){4,})"
)
_PAIR = re.compile(r"\s*[^\s:=]+(?: [^\s:=]+)?\s*[:=]\s*\S+(?: \S+)?\s*$")
_KEYED = re.compile(r"\s*[^\s:=]*[\w]_\d+\s*[:=]")
_REPEAT = re.compile(r"(.{1,6}?)\1{6,}", re.S)
_GAP = re.compile(r"\s{2,}|\t")
_PADDED = re.compile(r"\S\s{3,}$|^\s{6,}\S")
_NAME = re.compile(r"\s*[^\W\d_][\w -]{0,30}:\s*$")
_NUMBER = re.compile(r"[\"'(]?[-+]?\d[\d.,:/-]*%?[\"')]?$")
_WORD = re.compile(r"\b[^\W\d_]+(?:['’][^\W\d_]+)*\b")
_SIGN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_KANA = re.compile(r"[぀-ゟ]")
_ASCII_RUN = re.compile(r"[!-~]{30,}")
#: Signs that text decoded with a wrong charset is full of.
_MANGLED = re.compile(r"[\ufffd¤¼ÂÃ¿]|â€")
_STOP = re.compile(r"[^\W\d_]{2}[.!?…]+(?=\s|$)")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()¿¡«»„“”‘’…。、！？・「」€£$%&/@+-]|_")


def _cells(line: str, hits: int) -> bool:
    """Whether the line is a row of a table."""
    s = line.strip()
    bars = s.count("|")
    if bars >= 2 and (s[0] == "|" or bars >= 3 or " | " in s):
        return True
    if "\t" in s:
        cells = [c for c in s.split("\t") if c.strip()]
        if len(cells) >= 2 and sum(len(c.split()) for c in cells) <= 3 * len(cells):
            return True
    for mark in (";", ","):
        n = s.count(mark)
        if n >= 2 or (n == 1 and s[-1] != mark and len(s.split()) == 1):
            cells = s.split(mark)
            short = sum(len(c.split()) <= 2 for c in cells)
            if short == len(cells):
                if n >= 2 and not hits and not s.endswith("."):
                    return True
                tight = sum(c[:1] != " " for c in cells[1:])
                valued = sum(bool(_NUMBER.match(c.strip())) or c.strip() in ("", '""') or c.strip()[:1] in "\"'" for c in cells)
                if tight >= max(1, n - 1) or 2 * valued > len(cells):
                    return True
    if "   " in line or "  " in s:
        cells = _GAP.split(s)
        numbers = sum(bool(_NUMBER.match(c)) for c in cells)
        if all(len(c.split()) <= 2 for c in cells):
            if len(cells) >= 3 or numbers >= 1 and len(cells) == 2 or not hits and (len(cells) == 2 and "   " in s or _PADDED.search(line)):
                return True
    parts = s.split()
    return len(parts) >= 3 and 10 * sum(bool(_NUMBER.match(p)) for p in parts) >= 7 * len(parts)


def _junk(line: str, words: list[str]) -> bool:
    """Whether the line is machine output, noise or ornament."""
    s = line.strip()
    if len(s) <= 3:
        return False
    if not words and not _SIGN.search(s):
        return len(s) > 3
    solid = s.replace(" ", "")
    if len(solid) > 8 and 10 * len(_MANGLED.findall(solid)) > len(solid):
        return True
    runs = sum(len(r) for r in _ASCII_RUN.findall(s) if not r.isalpha() or len(r) > 60)
    if 2 * runs > len(s):
        return True
    if len(s) > 20 and 2 * sum(len(m.group()) for m in _REPEAT.finditer(solid)) > len(solid):
        return True
    return len(solid) > 8 and 3 * len(_ODD.findall(solid)) > len(solid)


class Counts:
    """Counts over a piece of text. `closed`: characters, and those that are no prose, of
    paragraphs that end in it. `head` and `tail`: the paragraphs open at its ends, each as
    characters of plain lines, words, frequent words, East Asian signs, kana, sentence ends, lines."""

    __slots__ = ("chars", "junk", "head", "tail", "broken")

    def __init__(self) -> None:
        self.chars = self.junk = 0
        self.head, self.tail, self.broken = [0] * 7, [0] * 7, False

    def row(self) -> list[int]:
        return [self.chars, self.junk, int(self.broken), *self.head, *self.tail]


def idle(block: list[int]) -> int:
    """Characters of a paragraph's plain lines that are no prose: all or none."""
    chars, words, common, signs, kana, stops, lines = block
    if signs >= FEW_SIGNS and signs >= words:
        return chars if kana < LEAST_KANA * signs else 0
    if words >= FEW_WORDS:
        spoken = common >= LEAST_COMMON * words or (common and words < SHORT) or (stops and 3 * stops <= words <= LONGEST_SENTENCE * stops and words > 3 * lines)
        return 0 if spoken else chars
    return 0


def count(piece: str, common: frozenset[str], following: str | None = None) -> Counts:
    """Counts over a piece that is cut between lines; `following` is how the line behind it begins, None at the end."""
    out = Counts()
    block = out.head
    lines = piece.split("\n")
    n_lines = len(lines)
    if following is not None:
        lines.append(following)
    for at, line in enumerate(lines[:n_lines]):
        n = len(line)
        if not n or line.isspace() and n < 40:
            if block is out.tail:
                out.junk += idle(out.tail)
                out.tail[:] = [0] * 7
            else:
                out.broken, block = True, out.tail
            out.chars += n
            continue
        out.chars += n
        words = _WORD.findall(line)
        hits = sum(w in common for w in map(str.lower, words))
        signs = len(_SIGN.findall(line)) if n != len(line.encode("utf-8", "replace")) else 0
        kana = len(_KANA.findall(line)) if signs else 0
        # "no" is a cell of many tables
        rare = hits - sum(w in ("no", "No", "NO") for w in words) if hits else 0
        sentence = len(words) >= 6 and rare >= 2 and 5 * hits >= len(words) or kana >= 6 and 5 * kana >= signs
        if sentence and 10 * len(_MANGLED.findall(line)) > n:
            sentence = False
        listed = rare == 0 and len(words) <= 3 and (line[:4] == "    " or (_NAME.match(line) and lines[at + 1 : at + 2] and lines[at + 1][:2] == "  "))
        if _MACHINE.match(line) or not sentence and (listed or _ITEM.match(line) or _KEYED.match(line) or _cells(line, rare) or _junk(line, words) or (hits == 0 and _PAIR.match(line))):
            out.junk += n
            continue
        block[0] += n
        block[1] += len(words) if not signs else 0
        block[2] += hits
        block[3] += signs
        block[4] += kana
        block[5] += len(_STOP.findall(line))
        block[6] += 1
    return out


def pieces(text: str, size: int) -> list[tuple[str, str | None]]:
    """The text cut between lines into pieces of about `size` characters, each with how the line behind it begins.

    No line is cut: a piece is longer only if a single line is.
    """
    out: list[tuple[str, str | None]] = []
    at, n = 0, len(text)
    while n - at > size:
        end = text.rfind("\n", at, at + size + 1)
        end = text.find("\n", at + size) if end < 0 else end
        if end < 0:
            break
        out.append((text[at:end], text[end + 1 : end + 3].partition("\n")[0]))
        at = end + 1
    out.append((text[at:], None))
    return out


_BLANK = re.compile(r"\s")


def word_pieces(text: str, size: int) -> list[tuple[str, None]]:
    """The text cut behind white space into pieces of `size` characters or, as no word is cut, up to a word more."""
    out: list[tuple[str, None]] = []
    at, n = 0, len(text)
    while n - at > size:
        blank = _BLANK.search(text, at + size - 1)
        if not blank:
            break
        out.append((text[at : blank.end()], None))
        at = blank.end()
    out.append((text[at:], None))
    return out
