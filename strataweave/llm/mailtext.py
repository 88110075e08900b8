"""What a reader of a raw message sees, cut into passages and folded into plain words.

All patterns take time in proportion to the text, also for very long words, lines
and unclosed tags. Works on whole texts: headers, every text part in its transfer encoding, quoted
and own text. A text without headers is taken as a body.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import html
import quopri
import re
import unicodedata

#: Levels of messages and parts within each other that are taken apart; what lies deeper is read as it stands.
DEPTH = 50
#: Words of a passage above which its windows are passages too, words of a window, and words from one to the next.
LONG, WINDOW, STEP = 22, 15, 7

_FIELD = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*(?:\n[ \t].*)*)", re.M)
_BOUNDARY = re.compile(r'boundary="?([^";\n]+)', re.I)
_CHARSET = re.compile(r'charset="?([^";\s]+)', re.I)
_WORD = re.compile(r"=\?([^?\s]+)\?([bqBQ])\?([^?]*)\?=")
_TAG = re.compile(r"(?is)<(script|style)\b(?:(?!</?\1\b).)*+</\1>|<!--(?:(?!-->|<!--).)*+-->|<[a-z/!][^<>]*+>")
_BREAK_TAG = re.compile(r"(?i)<(?:br|/?p|/?div|/?tr|/?li|/?h\d|/?table|/?blockquote)\b[^<>]*>")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
_ENCODED_LINES = re.compile(r"(?m)(?:^[A-Za-z0-9+/=]{60,}\n)+[A-Za-z0-9+/=]*")

# The end of a sentence, an empty line, or a line that ends too early to have been wrapped.
_SENTENCE = re.compile(r"(?<=[.!?:;])[\"')\]]*+\s++|\n[ \t]*+\n\s*+|(?<=\n)(?<!.{50}\n)(?=[^a-z\s])")
_BROKEN_UTF8 = re.compile(r"[\u00c2\u00c3\u00e2][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ]")

# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans(
    "абвеёкмнорстухіїјѕԁһԛԝɑгυνοαρτικεηωγχßøłđıⅼ",
    "abbeekmhopctyxiijsdhqwarvvoaptikenwyxsoldil",
)
# Digits and signs that stand for letters inside a word.
_LEET = str.maketrans("013457@$|", "oieastasl")

_ADDRESS = re.compile(r"(?<!\S)[^\s@]++@[^\s@.]++\.\S++|https?://\S++|www\.\S++")
_MIXED = re.compile(r"(?<![a-z0-9@$|])(?:[a-z]++[0-9@$|]|[0-9@$|]++[a-z])[a-z0-9@$|]*+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ \-._*~]{1,2}[^\W\d_]){2,}(?![^\W_])")
_SEPARATED = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"(?<=[a-z])[!#%&*?+^]+(?=[a-z])")
_RUN = re.compile(r"([a-z])\1+")
_TOKEN = re.compile(r"[a-z]+(?:\*[a-z]+)*")
_CONTROL = [chr(c) for c in range(32) if c not in (9, 10, 13)]
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f]")


def _wide(data: bytes, charset: str) -> str | None:
    """The UTF-16 or UTF-32 charset of data that have its mark, or are declared so and contain zero bytes."""
    if data.startswith((codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)):
        return "utf-32"
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    name = charset.lower().replace("_", "-")
    if not name.startswith(("utf-16", "utf-32")) or 0 not in data:
        return None
    if name in ("utf-16", "utf-32"):  # without a mark: the zero bytes of plain letters come first or last
        step = 2 if name == "utf-16" else 4
        name += "-be" if data[::step].count(0) > data[step - 1 :: step].count(0) else "-le"
    return name


def _decode(data: bytes, charset: str) -> str:
    if wide := _wide(data, charset):
        try:
            return data.decode(wide, "replace")
        except LookupError:
            pass
    for name in ("utf-8", charset, "cp1252"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def _mended(text: str) -> str:
    """UTF-8 that was read as a one-byte charset, read again."""
    if not _BROKEN_UTF8.search(text):
        return text
    out = []
    for line in text.split("\n"):
        for name in ("cp1252", "latin-1"):
            try:
                line = line.encode(name).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        out.append(line)
    return "\n".join(out)


def _words(m: re.Match) -> str:
    charset, kind, data = m.groups()
    try:
        raw = base64.b64decode(data + "==") if kind in "bB" else quopri.decodestring(data.replace("_", " "))
    except (binascii.Error, ValueError):
        return m.group()
    return _decode(raw, charset)


def _fields(head: str) -> dict[str, str]:
    return {k.lower(): v for k, v in _FIELD.findall(head)}


def _body(fields: dict[str, str], body: str, out: list[str], depth: int = 0) -> None:
    kind = fields.get("content-type", "text/plain")
    low = kind.lower()
    if (found := _BOUNDARY.search(kind)) and depth < DEPTH and f"--{found[1]}" in body:
        for i, part in enumerate(body.split(f"--{found[1]}")):
            if i == 0:  # before the first part
                continue
            if part.startswith("--"):
                out.append(part[2:])
                continue
            head, gap, rest = part.lstrip("\n").partition("\n\n") if not part.startswith("\n\n") else ("", "", part)
            if gap or part.startswith("\n\n"):
                _body(_fields(head), rest, out, depth + 1)
            else:
                _body({}, part, out, depth + 1)
        return
    if not (low.startswith(("text/", "message/", "multipart/")) or "/" not in low):
        return
    encoding = fields.get("content-transfer-encoding", "").strip().lower()
    charset = found[1] if (found := _CHARSET.search(kind)) else "utf-8"
    if encoding == "base64":
        text = _from_base64(body, charset)
    elif encoding == "quoted-printable" or "=\n" in body or "=3D" in body:
        text = _decode(quopri.decodestring(body.encode("utf-8", "surrogatepass")), charset)
    else:
        text = body
        if encoding != "7bit" or "\n" in body:
            text = _ENCODED_LINES.sub(lambda m: _from_base64(m.group(), charset), body)
    if "html" in low or "<html" in text.lower():
        text = html.unescape(_TAG.sub(" ", _BREAK_TAG.sub("\n\n", text)))
    if low.startswith("message/") and depth < DEPTH:
        head, gap, rest = text.lstrip("\n").partition("\n\n")
        if gap and (inner := _fields(head)):
            out.append(inner.get("subject", ""))
            _body(inner, rest, out, depth + 1)
            return
    out.append(text)


def _from_base64(body: str, charset: str) -> str:
    """Decoded text; bytes after a cut or around foreign characters are kept as far as they go. Binary data give nothing."""
    data = re.sub(r"[^A-Za-z0-9+/]", "", body)
    data = data[: len(data) // 4 * 4] + ((data[len(data) // 4 * 4 :] + "==")[:4] if len(data) % 4 > 1 else "")
    try:
        raw = base64.b64decode(data)
    except (binascii.Error, ValueError):
        return body
    text = _decode(raw, charset)
    return "" if sum(map(text.count, _CONTROL)) * 20 > len(text) else text


def visible(text: str) -> list[str]:
    """Subject and text parts of a raw message."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, gap, body = text.lstrip("\n").partition("\n\n")
    fields = _fields(head)
    if not ("subject" in fields or "from" in fields or "message-id" in fields or "date" in fields):
        fields, body = {}, text
    out = [_WORD.sub(_words, re.sub(r"\?=\s+=\?", "?==?", fields.get("subject", "")))] if fields else []
    _body(fields, body if gap or not fields else "", out)
    return [_mended(t) for t in out if t]


def fold(text: str) -> str:
    """Lower-case text with look-alikes, digits in words, spaced and stretched letters and accents undone.

    A sign between two letters becomes ``*``: it may hide a letter.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(_ALIKE)
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: _SEPARATED.sub("", m.group()), text)
    text = _MIXED.sub(lambda m: m.group().translate(_LEET), text)
    text = _HIDDEN.sub("*", text)
    return _RUN.sub(r"\1", text)


def passages(text: str | None) -> dict[tuple[str, ...], str]:
    """Distinct passages of a message as folded words, each with the text it came from.

    A passage of more than ``LONG`` words gives its windows besides, so that what
    stands around some words does not hide them.
    """
    out: dict[tuple[str, ...], str] = {}
    for part in visible(text or ""):
        part = _ADDRESS.sub(" ", _QUOTE.sub("", part)).rstrip()
        for sentence in _SENTENCE.split(part):
            if not sentence:
                continue
            words = tuple(_TOKEN.findall(fold(sentence)))
            if words and words not in out:
                out[words] = sentence
            for window in _windows(words):
                out.setdefault(window, sentence)
    return out


def _windows(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Overlapping windows over the whole of a long passage; a run of WINDOW - STEP + 1 words is whole in one of them."""
    if len(words) <= LONG:
        return []
    return [words[i : i + WINDOW] for i in (*range(0, len(words) - WINDOW, STEP), len(words) - WINDOW)]
