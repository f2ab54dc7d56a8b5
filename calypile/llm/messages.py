"""What the sender of a raw e-mail message wrote: body text without headers, attachments and quoted or forwarded messages.

Written for many messages a second, not for the whole standard: one pass over the lines, no message objects. Mixed line ends,
missing headers, unclosed and nested multiparts and cut base64 are read as far as they go. A text without headers is a body.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER = re.compile(r"(?:From [^\n]*|[!-9;-~]+[ \t]*:)")
_FIELD = re.compile(r"^([!-9;-~]+)[ \t]*:[ \t]*(.*(?:\n[ \t]+.*)*)", re.M)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"\n]+)"|([^\s;]+))', re.I)
_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
#: Text that is seen only where scripts or images are off, or never.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(head|style|script|title|template)\b.*?(?:</\1\s*>|\Z)|<(noscript)\b[^<>]*>.*?(?:</\2\s*>|\Z)", re.I | re.S)
_OPENING = re.compile(r"<(\w{1,20})\b([^<>]{1,2000})>")
_HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|(?:font-size|max-height)\s*:\s*0{1,4}(?:\.0{1,4})?(?:[a-z]{1,4}|%)?(?=[\s;!"'>]|$)""", re.I)
_HIDDEN_FLAG = re.compile(r"""(?<![^\s"'])hidden(?=[\s/=>]|$)""", re.I)
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
#: Styles under which the source's own blanks and line ends are shown.
_KEPT_SPACE = re.compile(r"white-space\s*:\s*(?:pre|break-spaces)", re.I)
_SPACE = re.compile(r"[ \t\n\f]+")
_QUOTED_HTML = re.compile(r"<(/?)(?:blockquote)\b[^<>]*>", re.I)
_CODE = re.compile(r"<(pre|code|kbd|samp|tt)\b[^<>]*>(.*?)</(?:pre|code|kbd|samp|tt)\s*>", re.I | re.S)
_BREAK = re.compile(r"<br\b[^<>]*>\s*\n?", re.I)
_BLOCK = re.compile(r"</?(?:p|div|tr|table|ul|ol|h[1-6]|section|article|body|html|hr)\b[^<>]*>", re.I)
_ITEM = re.compile(r"</?(?:li|td|th|dt|dd)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿‚-›Œ-žŸƒˆ˜€™]")
_MOJIBAKE_RUN = re.compile("(?:[Â-ô][\u0080-¿‚-›Œ-žŸƒˆ˜€™]{1,3})+")

_DASHED = re.compile(r"^[ >|]*-{3,} ?(?:original message|original-nachricht|ursprüngliche nachricht|forwarded message|weitergeleitete nachricht|message transféré|message d'origine|mensaje original|mensaje reenviado|messaggio originale|doorgestuurd bericht) ?-{3,}", re.I)
_SAID = re.compile(r"^(?:On|Am|Le|El|Il|Op|Em|Den|Στις)\b.{0,180}(?:wrote|schrieb|écrit|escribió|ha scritto|schreef|escreveu|skrev|έγραψε)\b.{0,80}:\s*$", re.I)
_QUOTE = re.compile(r"^[ \t]*(?:>|\|(?!\|))")
_BLOCK_HEAD = re.compile(r"^(?:From|Von|De|Da|Van|差出人)\s*:\s.*@", re.I)


def _fields(head: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _FIELD.findall(head):
        out.setdefault(name.lower(), value)
    return out


def _decoded(body: str, transfer: str, charset: str) -> str:
    if "base64" in transfer:
        kept = _BASE64.sub("", body.split("=")[0] if "=" in body else body)
        raw = binascii.a2b_base64(kept[: len(kept) // 4 * 4] + {2: kept[-2:] + "==", 3: kept[-3:] + "="}.get(len(kept) % 4, ""))
    elif "quoted-printable" in transfer:
        raw = binascii.a2b_qp(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def bodies(text: str) -> list[tuple[bool, str]]:
    """(is HTML, decoded text) of each body part that is shown, however deep in multiparts: attachments and parts of other types are left out."""
    out: list[tuple[bool, str]] = []
    todo = [(text, False)]  # the parts still to read, the next one last, and whether they are parts of a multipart
    while todo:
        part, inner = todo.pop()
        head, body = "", part
        if inner or _HEADER.match(part):
            bare = inner and part.startswith("\n")
            at = 0 if bare else part.find("\n\n")
            head, body = (part, "") if at < 0 else (part[:at], part[at + (1 if bare else 2) :])
            if at < 0 and not _FIELD.search(part):
                head, body = "", part
        fields = _fields(head)
        kind = fields.get("content-type", "text/plain")
        low = kind.lower()
        if low.startswith("multipart/"):
            named = _BOUNDARY.search(kind)
            mark = named and (named[1] or named[2])
            if not mark:
                out.append((False, body))
                continue
            parts = re.split(r"^--" + re.escape(mark) + r"(--)?[ \t]*$\n?", body, flags=re.M)
            own = []
            for closing, child in zip(parts[1::2], parts[2::2], strict=True):
                if closing:
                    break
                own.append((child, True))
            todo += own[::-1]
            continue
        placed = fields.get("content-disposition", "").lower()
        if "attachment" in placed or "filename" in placed or not low.startswith(("text/plain", "text/html")):
            continue
        charset = re.search(r'charset\s*=\s*"?([^\s";]+)', low)
        out.append((low.startswith("text/html"), _decoded(body, fields.get("content-transfer-encoding", "").lower(), charset[1] if charset else "")))
    return out


def _without_quotes(markup: str) -> str:
    """HTML with each blockquote element, nested ones included, as one marked line."""
    out, depth, at = [], 0, 0
    for m in _QUOTED_HTML.finditer(markup):
        if not depth:
            out.append(markup[at : m.start()])
        depth = max(0, depth + (-1 if m[1] else 1))
        at = m.end()
        if not depth:
            out.append("<p>&gt;</p>")
    return "".join(out) + ("<p>&gt;</p>" if depth else markup[at:])


def _without_hidden(markup: str) -> str:
    """HTML without elements whose own attributes hide them; one without a closing tag stays."""
    if not (_HIDDEN.search(markup) or _HIDDEN_FLAG.search(markup)):
        return markup
    low, out, at, missing = markup.lower(), [], 0, set()
    for m in _OPENING.finditer(markup):
        name = m[1].lower()
        if m.start() < at or name in missing or not (_HIDDEN.search(m[2]) or _HIDDEN_FLAG.search(_VALUE.sub('""', m[2]))):
            continue
        end = low.find(f"</{name}", m.end())
        if end < 0:
            missing.add(name)  # nor is there one for a later element
            continue
        out.append(markup[at : m.start()] + " ")
        close = low.find(">", end)
        at = len(markup) if close < 0 else close + 1
    return "".join(out) + markup[at:]


def _code_marked(markup: str, kept: bool) -> str:
    """Code elements as blocks of marked lines, other white space as one blank unless it is kept; only up to the last closing tag, as no opening one behind it can match."""
    last = max((m.end() for m in re.finditer(r"</(?:pre|code|kbd|samp|tt)\s*>", markup, re.I)), default=0)
    flat = (lambda x: x) if kept else (lambda x: _SPACE.sub(" ", x))
    out, at = [], 0
    for m in _CODE.finditer(markup, 0, last):
        out += [flat(markup[at : m.start()]), "\n\n" + re.sub(r"^", "\x01", _BREAK.sub("\n", m[2]), flags=re.M) + "\n\n"]
        at = m.end()
    return "".join(out) + flat(markup[at:])


def shown_html(markup: str) -> str:
    """The text an HTML part shows, block by block; code elements are indented as code is in plain text."""
    markup = _without_quotes(_without_hidden(_UNSEEN.sub(" ", markup.replace("\x01", " "))))
    kept = bool(_KEPT_SPACE.search(markup))
    markup = _ITEM.sub("\n", _BLOCK.sub("\n\n", _BREAK.sub("\n", _code_marked(markup, kept))))
    markup = _TAG.sub("", markup)
    if not kept:
        markup = re.sub(r"^ +", "", markup, flags=re.M)  # also what stood between tags
    return html.unescape(markup.replace("\x01", "    ")).replace("\xa0", " ")


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, read again; anything else unchanged."""
    if not _MOJIBAKE.search(text):
        return text

    def again(m: re.Match) -> str:
        raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252", "replace") for c in m[0])
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _MOJIBAKE_RUN.sub(again, text)


def unquoted(body: str) -> list[str]:
    """The lines of a body up to and without quoted and forwarded messages."""
    out: list[str] = []
    lines = body.split("\n")
    for i, line in enumerate(lines):
        if _QUOTE.match(line):
            # a wrapped attribution above a quotation goes with it
            while out and not out[-1].strip():
                out.pop()
            if out and out[-1].rstrip().endswith((":", "：")) and ("@" in out[-1] or _SAID.match(out[-1].strip())):
                out.pop()
            continue
        if _DASHED.match(line):
            break
        if _SAID.match(line.strip()):
            following = next((x for x in lines[i + 1 :] if x.strip()), "")
            if _QUOTE.match(following):
                continue  # the quotation's own lines are marked, so an answer may follow below
            break
        if _BLOCK_HEAD.match(line) and any(re.match(r"(?:Sent|Date|Gesendet|Datum|Envoyé|Enviado|Fecha|Subject|Betreff)\s*:", x) for x in lines[i + 1 : i + 4]):
            break
        out.append(line)
    return out


def own_paragraphs(text: str | None) -> list[list[str]]:
    """For each shown body part, the sender's own paragraphs: lines between blank lines, still with their line ends."""
    if not text or text.isspace():
        return []
    out = []
    for is_html, body in bodies(text.replace("\r\n", "\n").replace("\r", "\n")):
        body = repaired(shown_html(body) if is_html else body)
        own = "\n".join(x.rstrip() for x in unquoted(body))
        out.append([p.strip("\n") for p in re.split(r"\n{2,}", own) if p.strip()])
    return out
