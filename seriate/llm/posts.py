"""The poster's own words in a forum post: without quotes, signatures, code and mark-up."""

from __future__ import annotations

import re

from seriate.llm.leaks import decode_entities, without_unseen

_TAG = re.compile(r"\[(/?)quote\b[^\]\n]*\]|<(/?)blockquote\b[^<>]*>", re.I)
_BREAK = re.compile(r"<br\s*/?>|</?p\b[^<>]*>|</?div\b[^<>]*>|<hr\s*/?>", re.I)
#: How the lines before line-quoted text end, in the languages of the corpus.
_LEAD = re.compile(r"^\s*(?:@\S+|.{1,80}\b(?:wrote|said|schrieb|écrit|escribió))\s*:?\s*$", re.I)
_SIGNATURE = re.compile(r"^\s*(?:--|—|_{3,})\s*$")
_CODE = re.compile(r"\[code\b[^\]]*\].*?(?:\[/code\]|\Z)|<pre\b[^<>]*>.*?(?:</pre>|\Z)|<code\b[^<>]*>.*?(?:</code>|\Z)|^```.*?(?:^```|\Z)", re.S | re.I | re.M)
_LINK = re.compile(r"https?://([^\s/\"'<>\])]+)[^\s\"'<>\])]*", re.I)
_MARKUP = re.compile(r"<[^<>]*>|\[/?[a-zA-Z*]+(?:=[^\[\]]*)?\]")
_MISREAD = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")


def _reread(m: re.Match) -> str:
    raw = b""
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            raw += c.encode("latin-1", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def mend(text: str) -> str:
    """UTF-8 that was read as a one-byte character set, read again."""
    return text if text.isascii() else _MISREAD.sub(_reread, text)


def without_quotes(text: str) -> str:
    """Without text between quote tags, nested ones too. A quote that is never closed ends at the next line break outside quotes in it."""
    tags = [(m.start(), m.end(), bool(m.group(1) or m.group(2))) for m in _TAG.finditer(text)]
    if not tags:
        return text
    partner: dict[int, int] = {}
    stack: list[int] = []
    for i, (_, _, close) in enumerate(tags):
        if not close:
            stack.append(i)
        elif stack:
            partner[stack.pop()] = i
    out, at, i = [], 0, 0
    while i < len(tags):
        start, end, close = tags[i]
        out.append(text[at:start])
        if close:  # without a quote before it
            at, i = end, i + 1
        elif i in partner:
            at, i = tags[partner[i]][1], partner[i] + 1
            out.append("\n")
        else:
            # Skip to the line break, past whole quotes inside.
            at, i = end, i + 1
            while True:
                stop = text.find("\n", at)
                if i < len(tags) and (stop < 0 or tags[i][0] < stop):
                    if i in partner:
                        at, i = tags[partner[i]][1], partner[i] + 1
                    else:
                        at, i = tags[i][1], i + 1
                    continue
                at = len(text) if stop < 0 else stop
                break
    out.append(text[at:])
    return "".join(out)


def own_paragraphs(text: str | None) -> tuple[list[str], list[str]]:
    """Paragraphs of the poster's own words, and the hosts of the links among them. None, empty and blank texts have none."""
    if not text or text.isspace():
        return [], []
    text = without_unseen(mend(decode_entities(text))).replace("\r\n", "\n").replace("\r", "\n")
    kept: list[str] = []
    for line in text.split("\n"):
        if line.lstrip()[:1] in (">", "|"):
            if kept and _LEAD.match(kept[-1]):
                kept.pop()
            continue
        kept.append(line)
    text = _BREAK.sub(lambda m: "\n\n" if m.group().lower().startswith(("<p", "</p")) else "\n", without_quotes("\n".join(kept)))
    body: list[str] = []
    for line in text.split("\n"):
        if _SIGNATURE.match(line):
            break
        body.append(line)
    text = _CODE.sub(" ", "\n".join(body))
    hosts = [m.group(1).lower() for m in _LINK.finditer(text)]
    text = _MARKUP.sub(" ", _LINK.sub(" ", text))
    return [p for p in re.split(r"\n\s*\n", text) if p.strip()], hosts
