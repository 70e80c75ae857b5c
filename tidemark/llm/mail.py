"""The sender's own text of a raw mail.

Pure Python over one text: no Spark here, so executors import nothing else.
Headers, quoted and forwarded mails, disclaimers, attachments and HTML copies
are left out; greeting and signature stay.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"^[!-9;-~]+[ \t]*:", re.ASCII)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"\n]+)"|([^\s;"]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_TAG = re.compile(r"<[^<>]*>")
_BREAK = re.compile(r"<br\s*/?>\n?|</p>\n?", re.I)
_RULE = re.compile(r"^\s*([*=_#~+-])(?:[ ]?[*=_#~+-]){3,}\s*$")
#: A line between dashes, or one that ends with a colon, which announces a forwarded or replied-to mail if its headers follow.
_MARK = re.compile(r"^\s*-{2,}\s*[^\W\d_][^\n]{2,60}?\s*-{2,}\s*$|^[^\W\d_][^\n]{4,60}[:：]\s*$")
#: A header line of a mail that is quoted in the text, in any language: a name of one or two words and a value.
_FIELD = re.compile(r"^\s*\*?[^\W\d_]{2,14}(?:[ -][^\W\d_]{1,12})?\*?\s?[:：](?!//)\*? ?\S")
#: What one of the headers of a quoted mail has: an address or a time.
_ADDRESS = re.compile(r"\S@\S|\d{1,2}:\d{2}")
#: A line that names who wrote the quoted text below it: a verb of writing in the languages of the archive and their neighbours.
_WROTE = re.compile(r"(?:\bwrote|\bschrieb\b.*|a écrit|escribió|escreveu|ha scritto|schreef\b.*|skrev\b.*|пишет|написал\w*|のメール)\s*[:：]\s*$", re.I)
_NAMED = re.compile(r"^.{4,120}, [^,:]{3,60}:$")
#: A date or time, also a short one or seconds since 1970, by which a line above bars names a quoted sender.
_WHEN = re.compile(r"\d{1,2}:\d{2}|\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\b\d{1,2}\.? \w{2,}|\b\d{9,}\b|^[\s>|]*\w{2,3}, \d{1,2}\b|\d{4}年")
_GRID = re.compile(r"^\+[-=+:]+\s*$")
#: Subjects of legal and courtesy notices, a group for each, by word stems. None alone makes a notice: see _notice.
_SUBJECTS = re.compile(
    r"(?P<label>^\W{0,4}(?:confidential(?:ity)?(?: notice)?|disclaimer|legal notice|haftungsausschluss|avertissement|aviso legal)\s*:)"
    r"|(?P<secret>\bconfiden[ct]i|\bprivileged\b|\bvertraulich|\bvertrouwelijk|\bkonfidenti|конфиденциальн|機密)"
    r"|(?P<addressee>\baddressee|\brecipient|\bintended (?:for|only|solely)|\bempfänger|\bdestinat[aá]|\bgeadresseerde|\bmottagare|адресат|получател|宛先|受信者)"
    r"|(?P<error>\bin error\b|\bby mistake|\birrtümlich|\bversehentlich|\bpar erreur|\bpor error|\bper errore|\babusievelijk|\bav misstag|по ошибке|誤って)"
    r"|(?P<delete>\bdelet|\bdestroy|\blösch|\bvernicht|\bdétrui|\bsupprim|\belimin|\bcancell|\bverwijder|\bradera|удалит|削除)"
    r"|(?P<liable>\bliab|\bwarrant|\bhaft(?:et|ung)|\bgewähr|\bresponsab|\bgarant|\baansprakelijk|\bansvar|ответственност)"
    r"|(?P<contract>\bcontract|\blegally binding|\bverträge?\b|\brechtsverbindlich|\bcontrat)"
    r"|(?P<views>\b(?:views|opinions)\b.{0,40}\b(?:writer|author|sender|firm|company)|\bansichten\b|\bmeinungen\b)"
    r"|(?P<malware>\bmalware|\bvirus|\bschadsoftware|вирус)"
    r"|(?P<print>\b(?:before|bevor|avant d|antes de)\b.{0,20}\b(?:print|druck|ausdruck|imprim)|\benvironment|\btrees\b|\bumwelt\b)"
    r"|(?P<firm>\bregistered (?:under|in|office|no\b|number)|\bcompany (?:no|number)\b|\bhandelsregister|\bsiège social)",
    re.I | re.S,
)
_QUOTE = (">", "|")
_COLONS = (":", "：")


def _head(text: str, at: int, stop: int | None = None) -> tuple[dict[str, str], int]:
    """The headers that begin at `at`, by lower-case name, and where what follows them begins; nothing from `stop` on is read."""
    found: dict[str, list[str]] = {}
    name = ""
    n = len(text) if stop is None else stop
    while at < n:
        end = text.find("\n", at, n)
        end = n if end < 0 else end
        line = text[at:end]
        if not line.strip():
            at = min(end + 1, n)
            break
        if line[0] in " \t" and name:
            found[name].append(line.strip())
        elif _HEADER.match(line):
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = [value.strip()]
        elif not found and line.startswith("From "):
            name = ""
        else:
            break
        at = end + 1
    return {k: " ".join(v) for k, v in found.items()}, min(at, n)


def _decoded(body: str, head: dict[str, str]) -> str:
    coding = head.get("content-transfer-encoding", "").lower()
    if "quoted-printable" not in coding and "base64" not in coding:
        return body
    found = _CHARSET.search(head.get("content-type", ""))
    charset = found.group(1) if found else "utf-8"
    try:
        if "base64" in coding:
            raw = base64.b64decode("".join(body.split()))
        else:
            raw = quopri.decodestring(body.encode("utf-8"))
    except (binascii.Error, ValueError):
        return body
    for name in (charset if charset.lower() not in ("us-ascii", "ascii") else "utf-8", "utf-8", "latin-1"):
        try:
            return raw.decode(name).replace("\r\n", "\n")
        except (UnicodeDecodeError, LookupError):
            continue
    return body


def _untagged(body: str) -> str:
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", body)))


def _parts(text: str, at: int, head: dict[str, str]):
    """(content type, attached?, decoded text, alternatives) of the leaves of a message, however deep they lie.

    `alternatives` has, from the outermost on, a number for each multipart/alternative
    around the leaf and the number of the part of it that the leaf is in.
    """
    stack: list[tuple] = [(at, len(text), head, ())]
    met = 0
    while stack:
        at, stop, head, way = stack.pop()
        kind = head.get("content-type", "text/plain")
        low = kind.lower()
        found = _BOUNDARY.search(kind) if low.startswith("multipart/") else None
        if not found:
            attached = head.get("content-disposition", "").lower().startswith("attachment")
            if attached or not low.startswith("text/"):
                yield low, True, "", way
            else:
                yield low, False, _decoded(text[at:stop], head), way
            continue
        mark = "--" + (found.group(1) or found.group(2))
        begin = at if text.startswith(mark, at, stop) else text.find("\n" + mark, at, stop) + 1 or -1
        if begin < 0:
            yield "text/plain", False, text[at:stop], way
            continue
        met += 1
        inner: list[tuple] = []
        while begin >= 0:
            end_line = text.find("\n", begin, stop)
            if end_line < 0 or text.startswith("--", begin + len(mark), stop):
                break
            end = text.find("\n" + mark, end_line, stop)
            last = stop if end < 0 else max(end, end_line + 1)
            own, start = _head(text, end_line + 1, last)
            inner.append((start, last, own, (*way, (met, len(inner))) if low.startswith("multipart/alternative") else way))
            begin = end + 1 or -1
        stack += reversed(inner)


def readable(text: str | None) -> str | None:
    """The decoded plain text of a mail, quoted mails and notices included; None if it has none.

    All inline parts of plain text together, or else of HTML; of alternatives the first that has any.
    """
    if text is None or not text.strip():
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, at = _head(text, 0)
    found: dict[str, list[str]] = {"plain": [], "other": [], "html": []}
    taken: dict[tuple[str, int], int] = {}
    for kind, attached, body, way in _parts(text, at, head):
        if attached:
            continue
        sort = "html" if kind.startswith("text/html") else "plain" if kind.startswith("text/plain") else "other"
        if all(taken.setdefault((sort, number), part) == part for number, part in way):
            found[sort].append(_untagged(body) if sort == "html" else body)
    bodies = found["plain"] or found["other"][:1] or found["html"]
    if len(bodies) > 1:
        return "\n\n".join(b.strip("\n") for b in bodies if b.strip())
    return bodies[0] if bodies else None


def _table_bars(lines: list[str]) -> set[int]:
    """Indices of lines that begin with a bar and are rows of a table, not quoted text.

    A run of such lines is a table if each is a row and no line above names a quoted
    sender: they have equal numbers of bars, or each has a closing one. Rules of a grid
    may stand between rows; one row between such rules is a table too. Rows that all have
    an empty first cell of one space are a quoted table.
    """
    out: set[int] = set()
    run: list[int] = []
    named = ruled = False
    for i, line in enumerate([*lines, ""]):
        if line[:1] == "|":
            run.append(i)
            continue
        if line[:1] == "+" and _GRID.match(line):
            if named or any(lines[k].count("|") < 2 for k in run):
                run = []
            named, ruled = False, True
            continue
        if len(run) >= 2 - ruled and run and not named:
            rows = [lines[k].rstrip() for k in run]
            bars = {r.count("|") for r in rows}
            closed = min(bars) >= 3 and all(r.endswith("|") for r in rows)
            if (closed or (len(bars) == 1 and min(bars) >= 2)) and not all(r.startswith("| |") for r in rows):
                out.update(run)
        run, ruled = [], False
        if line.strip():
            named = bool(_WROTE.search(line) or (_NAMED.match(line) and _WHEN.search(line)))
    return out


def _forwarded(lines: list[str], at: int) -> bool:
    """Whether the line announces a mail that follows: the next line with something in it is a header; without dashes,
    the next three are, and have an address or a time."""
    if not _MARK.match(lines[at]):
        return False
    need = 1 if lines[at].lstrip().startswith("--") else 3
    fields = [x for x in lines[at + 1 : at + 8] if x.strip()][:need]
    return len(fields) == need and all(_FIELD.match(x) for x in fields) and (need == 1 or any(_ADDRESS.search(x) for x in fields))


def _notice(lines: list[str], ruled: bool) -> int:
    """How many of a paragraph's lines stand before a notice that ends it; all if it has none.

    A notice touches at least three of its subjects; a label counts as two, or as three if
    a rule stands above it. It begins below the rule, else with the paragraph or the last line
    from which on it touches all of them.
    """
    text = " ".join(lines)
    subjects = {m.lastgroup for m in _SUBJECTS.finditer(text)}
    if len(subjects) + ("label" in subjects) * (1 + ruled) < 3:
        return len(lines)
    if ruled:
        return 0
    for k in range(len(lines) - 1, 0, -1):
        if {m.lastgroup for m in _SUBJECTS.finditer(" ".join(lines[k:]))} >= subjects:
            # a full line above that doesn't end a sentence is the notice's own, wrapped
            return k if k > 1 or len(lines[0]) < 40 or lines[0].rstrip()[-1:] in ".!?…。:" else 0
    return 0


def _without_notices(lines: list[str]) -> list[str]:
    """The lines without notices. A notice is a paragraph, or its end, behind which own words no longer come before a
    quote or the end; the rule above it goes with it. A quote left a None behind."""
    paragraphs: list[tuple[int, int]] = []
    at, n = 0, len(lines)
    while at < n:
        end = at
        while end < n and lines[end] and lines[end].strip() and (end == at or not _RULE.match(lines[end])):
            end += 1
        if end > at:
            paragraphs.append((at, end))
        at = max(end, at + 1)
    dropped: set[int] = set()
    last, gone = True, False
    follows = n
    for begin, end in reversed(paragraphs):
        last = last or any(x is None for x in lines[end:follows])
        follows = begin
        if not last:
            gone = False
            continue
        ruled = bool(_RULE.match(lines[begin]))
        if ruled and end == begin + 1:
            # a rule alone goes if the notice below it went
            if gone:
                dropped.add(begin)
            gone = False
            continue
        own = begin + ruled
        above = ruled or any(_RULE.match(lines[k] or "") for k in range(max(0, begin - 2), begin))
        kept = own + _notice(lines[own:end], above)
        gone = last = kept == own
        if kept < end:
            dropped.update(range(begin if gone else kept, end))
    return [x or "" for k, x in enumerate(lines) if k not in dropped]


def own_body(text: str | None) -> str | None:
    """What the sender wrote: None for null or blank text or a mail without own words.

    Line ends become \\n. Quoted lines go with the line that names their sender, forwarded
    mails with what announces them, notices with their rule.
    """
    body = readable(text)
    if body is None:
        return None
    lines = body.split("\n")
    bars = _table_bars(lines) if "|" in body else set()
    kept: list[str | None] = []
    n = len(lines)
    i = 0
    while i < n:
        line = lines[i]
        if line[:1] in _QUOTE and line and i not in bars:
            # the line that names the quoted sender belongs to the quote, also when it is wrapped
            while kept and not (kept[-1] or "").strip():
                kept.pop()
            if kept and (_WROTE.search(kept[-1]) or _NAMED.match(kept[-1]) or (kept[-1].rstrip()[-1:] in _COLONS and _WHEN.search(kept[-1]))):
                kept.pop()
            while i < n and lines[i] and lines[i][:1] in _QUOTE and i not in bars:
                i += 1
            kept.append(None)
            continue
        if line and (line.lstrip()[:2] == "--" or line.rstrip()[-1:] in _COLONS) and _forwarded(lines, i):
            break
        kept.append(line)
        i += 1
    result = "\n".join(_without_notices(kept)).strip("\n")
    return result if result.strip() else None
