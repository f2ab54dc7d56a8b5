"""Messages whose own text is a leftover of the sending system: placeholders, missing values, filler, error pages, script notices.

A positive-unlabelled naive Bayes model is learned by expectation-maximization over the passages (paragraphs) of all messages.
The positives are trusted passages only: placeholders that stand alone in a greeting or closing line, and error pages, notices
and filler that are all there is in a message. All others are unlabelled: they start as negatives, and each round gives them
their posterior under the model of the round before. Placeholders are those of the listed
forms, and names between any other two or more mirrored marks; what such marks tell is learned: they count only where the model has found them
in greetings and closings, at half weight, and in passages that score as residue. The final model scores every passage, and a record is decided from its
passages: a placeholder or missing value counts if its passage scores as residue and it stands in running text, not in code
or quotation marks; other residue counts only if the record holds no ordinary content of its own beside it. What stands behind a
colon may be cited: the words before the colon are features of it.

Texts are parsed once, in their partition. What is kept of a message is a nested list of hashed features, written to the checkpoint
folder; a round is one pass over those, and what reaches the driver is two numbers for each feature of at least LEAST passages.
Null, empty and blank texts have no passages and are never found; equal texts get equal decisions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calypile.llm.messages import own_paragraphs
from calypile.llm.tokens import strings
from calypile.session import checkpointed, spread

#: Features are told apart by so many bits: all that a stored int holds without its sign.
HASH_BITS = 31
#: Rounds of expectation-maximization. The second one mends what the trusted passages alone get wrong; run until it settles, the model
#: drifts from residue to whatever is repeated (figures in the README), so it is stopped early and its prior stays that of the trusted.
ROUNDS = 3
#: A passage counts as residue above this log-odds, and as ordinary content below it.
CUT = 0.0
SMOOTHING = 1.0
#: Different words up to which a longer passage may be mere repetition.
FEW_WORDS = 14
#: A feature of fewer passages says nothing: what is seen once or twice tells only of itself.
LEAST = 3
#: The weight as a positive with which passages of bare short messages start.
SUSPECT = 0.5
#: Words of own content up to which a message without greeting and closing is bare, and short.
BARE_WORDS, SHORT_WORDS = 60, 25
#: Words whose hashes a task remembers; others are hashed anew each time.
KNOWN_WORDS = 500_000
#: Words from which a paragraph counts as content of its own.
CONTENT_WORDS = 5
#: Words before a colon that tell of the passage behind it.
LEAD_WORDS = 8

# --- fixed values: the forms in which systems leave placeholders, and the words they print for a missing value

_NAME = r"[A-Za-zÀ-ÿ][\w.]{0,40}(?:[ -][\w.]{1,40}){0,3}"  # of bounded length, so that no long word is tried over and over
PLACEHOLDERS = [
    r"\{\{\{? ?[\w.$ |'\"()-]{1,60} ?\}?\}\}",
    r"\{% ?\w+ [^{}%\n]{1,50}%\}",
    r"<%[=-]? ?[^<>%\n]{1,50} ?%>",
    rf"<<\s?{_NAME}\s?>>",
    rf"«{_NAME}»",
    rf"‹{_NAME}›",
    rf"[$#@]\{{{_NAME}\}}",
    rf"%%{_NAME}%%",
    rf"\[%[=-]? ?{_NAME} ?%\]",
    rf"\*\|{_NAME}(?::[\w.]{1,40})?\|\*",
    r"(?<!\w)__[A-Za-z][\w.]{0,60}?[A-Za-z0-9]__(?!\w|\.\w)",
    rf"@@{_NAME}@@",
    rf"##{_NAME}##",
    rf"\[\[{_NAME}\]\]",
    r"%\([\w. ]{1,60}\)[sd]",
    r"(?<![\w%])%[A-Za-z][A-Za-z_.]{2,40}%(?![\w%])",
    r"(?<![\w\])}{$#@\\])\{\d{1,2}\}(?![\w{])",
    r"(?<![\w\])}{$#@\\])\{[A-Za-z][\w.]{1,40}(?: [\w.]{1,40}){0,3}\}(?![\w{])",
    r"(?<![\w$])\$[A-Z][A-Z_]{2,}\b|(?<![\w$])\$[a-z]+_[a-z_]+\b",
    r"\[(?i:enter|insert|add|your|type|fill in|choose|select|put|please enter|ihr|ihre|votre|su|hier)\s[^\[\]\n]{1,50}\]",
    r"\[[A-Z]{2,30}[ _][A-Z_ ]{2,30}\]",
    r"\((?i:your|insert|enter|ihr|votre|su) [^()\n]{1,50}(?i:here|hier|ici|aquí)\)",
]
MISSING = r"\[object \w+\]|(?<![\w\"'./-])(?:undefined|null|NULL|NaN|None|nil|\(null\)|#N/A|N/A|<null>|\(none\))(?![\w\"'/-])"
_PH = re.compile("|".join(PLACEHOLDERS))
_MISSING = re.compile(MISSING)
_QUOTES = re.compile(r'"[^"\n]{1,200}"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|‘[^’\n]{1,200}’|« [^»\n]{1,200} »|「[^」\n]{1,200}」|\x60[^\x60\n]{1,200}\x60|(?<!\w)\'[^\'\n]{1,200}\'(?!\w)')

#: Two or more marks in a row, as delimiters of a placeholder of any other form; quotation marks, brackets of asides, full stops and dashes are none.
_MARKS = re.compile(r"(?:[^\w\s.,;:!?'\"()/\-“”„‘’`…–—¶]|_){2,}")
_INNER = re.compile(r"\s?[^\W\d_][\w.]*(?:[ -][\w.]+)*\s?")
_MIRROR = str.maketrans("{}[]<>«»‹›()", "}{][><»«›‹)(")

_STATUS = r"(?:4\d\d|5\d\d)"
_ERROR = re.compile(
    rf"^(?:HTTP\b.{{0,12}}{_STATUS}|(?:error|fehler|erreur) ?:? ?{_STATUS}|{_STATUS} [A-Z][a-z]+ ?[A-Z]?[a-z]*|Traceback \(most recent call last\)|(?:Render|Template|Internal|Syntax|Fatal|Runtime|Parse|Uncaught|Liquid) ?(?:server )?(?:error|exception)\b|\w+(?:Error|Exception)\b:)"
    r"|^(?:page not found|access denied|bad gateway|gateway timeout|service unavailable|internal server error|seite nicht gefunden|zugriff verweigert|page introuvable|accès refusé|página no encontrada|acceso denegado|ページが見つかりません|страница не найдена|η σελίδα δεν)\b",
    re.I,
)
_SCRIPTS = ("javascript", "java script", "script", "skript", "active content", "スクリプト", "скрипт", "σενάρια")
_FILLER = re.compile(r"^(?:lorem ipsum|dolor sit amet|(?:bla+h?[ ,.]+){3,}|(?:x{2,}[ ,.]+){3,}|(?:foo|bar|baz)\b(?: (?:foo|bar|baz)\b){2,}|(?:dies ist )?(?:ein )?blindtext|texto de relleno|faux texte|texte factice|dummy text|your text here|text goes here)", re.I)
_GREETING = re.compile(r"^(?:dear|hi|hello|hey|welcome|good (?:morning|afternoon|evening|day)|greetings|hallo|guten|liebe[rs]?|sehr|moin|bonjour|bonsoir|cher|chère|salut|hola|buenos|buenas|estimad[oa]s?|querid[oa]|ciao|gentile|caro|beste|здравствуйте|добрый|уважаем\w+|γεια|αγαπητ\w+)\b", re.I)
_HONORIFIC = re.compile(r"(?:様|さん|殿)[、,]?$")
_CLOSING = re.compile(r"^(?:kind|best|warm|many|with|yours|cheers|thanks|thank you|regards|sincerely|mit |viele |beste |freundliche|herzliche|liebe |cordialement|bien à|salutations|amicalement|merci|un saludo|saludos|atentamente|cordiali|με εκτίμηση|с уважением|よろしく|敬具)", re.I)
_NOTICE = (
    "confidential", "addressee", "by mistake", "private and protected", "before you print", "not allowed", "vertraulich", "empfänger", "irrtum", "weitergabe",
    "confidentiel", "destinataire", "erreur, merci", "toute copie", "confidencial", "destinatario", "конфиденциальн", "εμπιστευτικ", "unsubscribe", "html format",
)
#: A text without any of these holds no placeholder, or no missing value.
_SLOT_MARKS = ("{", "<%", "<<", "«", "‹", "%", "*|", "__", "@@", "##", "[[", "$", "[", "(")
_MISSING_MARKS = ("[object", "undefined", "null", "NULL", "NaN", "None", "nil", "N/A", "(none)")

_WORD = re.compile(r"[^\W\d_]+|\d+|[¶]\w+¶")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]+")
_KEYS = frozenset("qwertasdfgjkl")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")


def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1)


def shaped(text: str, token: str | None = None) -> tuple[str, int]:
    """(text with names between mirrored marks replaced by a token of their marks or the given one, their number): the learned shapes of placeholders.

    One pass over the marks; names may have any length.
    """
    out, at, n = [], 0, 0
    opening: re.Match | None = None
    for m in _MARKS.finditer(text):
        if opening is not None and m[0] == opening[0].translate(_MIRROR)[::-1] and _INNER.fullmatch(text, opening.end(), m.start()):
            out += [text[at : opening.start()], f" {token or '¶shape' + ''.join(f'{ord(c):x}' for c in m[0]) + '¶'} "]
            at, n, opening = m.end(), n + 1, None
        else:
            opening = m
    return "".join(out) + text[at:], n


def _is_code(paragraph: str) -> bool:
    lines = paragraph.split("\n")
    if re.match(r"(?: {3,}|\t)\S", lines[0]):
        return True
    if re.match(r"\s*[\[{]\s*\"?\w+\"?\s*[:,]", paragraph) and paragraph.rstrip().endswith(("}", "]")):
        return True
    return all(re.match(r"[+-](?![+-] )\s", x) for x in lines)


class Passage:
    """What the decision needs of one paragraph."""

    __slots__ = ("after", "code", "kind", "low", "repeats", "shapes", "size", "slots", "text", "words")

    def __init__(self, paragraph: str, after: tuple[str, ...]):
        self.after = after
        self.code = _is_code(paragraph)
        text = " ".join(paragraph.split())
        self.slots = self.shapes = 0
        slot = any(x in text for x in _SLOT_MARKS) and _PH.search(text)
        missing = any(x in text for x in _MISSING_MARKS) and _MISSING.search(text)
        if slot or missing or (_MARKS.search(text) and shaped(text)[1]):
            if self.code:
                text = _MISSING.sub(" ¶codemissing¶ ", shaped(_PH.sub(" ¶codeslot¶ ", text), "¶codeslot¶")[0])
            else:
                quoted = _QUOTES.sub(lambda m: " ¶quoted¶ " + _MISSING.sub(" ¶quotedslot¶ ", shaped(_PH.sub(" ¶quotedslot¶ ", m[0]), "¶quotedslot¶")[0]), text)
                text, n = _PH.subn(" ¶slot¶ ", quoted)
                text, k = _MISSING.subn(" ¶missing¶ ", text)
                text, self.shapes = shaped(text)
                self.slots = n + k
        self.text, self.low = text, text.lower()
        self.words = _WORD.findall(self.low)
        wide = sum(map(len, _WIDE.findall(text))) if not text.isascii() else 0
        self.size = len(self.words) + wide // 4
        if text.startswith("--") or text.startswith("________"):
            self.kind = "signature"
        elif len(self.words) <= 9 and (_GREETING.match(self.low) or _HONORIFIC.search(text)):
            self.kind = "greeting"
        elif len(self.words) <= 10 and _CLOSING.match(self.low):
            self.kind = "closing"
        elif not (self.slots or self.shapes) and any(x in self.low for x in _NOTICE):
            self.kind = "notice"
        else:
            self.kind = "short" if self.size < 3 else "body"
        self.repeats = self._repeats()

    def _repeats(self) -> bool:
        """The same sentence again and again, or few different words in a long stretch."""
        if self.kind != "body" or self.code or (not self.text.isascii() and _WIDE.search(self.text)):
            return False
        n = len(self.words)
        few = len({w for w in self.words if not w.isdigit()})
        if n >= 8 and few <= FEW_WORDS and few * 3 <= n:
            return sum(map(str.isdigit, self.words)) * 5 < n  # tables and logs repeat words between their figures
        parts = [x for x in _SENTENCE.split(self.text) if x]
        return len(parts) >= 3 and len(set(parts)) * 3 <= len(parts)

    def announces(self) -> tuple[str, ...]:
        """Features for the passage behind a colon, which may be cited or not: the colon and the last words before it."""
        if self.kind != "body" or not self.text.endswith((":", "：", " read")):
            return ()
        return "¶aftercolon¶", *(f"¶<{w}¶" for w in dict.fromkeys(self.words[-LEAD_WORDS:]) if w[0] != "¶" and not w.isdigit())

    def filler(self) -> bool:
        """Known filler, repetition, or words typed on neighbouring keys."""
        if self.repeats or _FILLER.match(self.low):
            return True
        words = set(self.words)
        return len(words) >= 6 and sum(len(w) > 2 and _KEYS.issuperset(w) for w in words) >= 0.8 * len(words)

    def says(self) -> bool:
        """An error page's or a script notice's own line, or filler."""
        return bool(_ERROR.match(self.text)) or (self.size <= 25 and any(x in self.low for x in _SCRIPTS))


def word_tokens(word: str) -> tuple[str, ...]:
    """The features of one lower-case word: itself and its ending; digits by length; a run of one letter; Japanese by pairs."""
    if word[0] == "¶":
        return (word,)
    if word.isdigit():
        return ("#" + str(len(word)),)
    if len(word) > 1 and len(set(word)) == 1:
        return ("=same",)
    if _WIDE.match(word):
        return tuple(word[i : i + 2] for i in range(len(word) - 1)) or (word,)
    keys = ("=k",) if len(word) >= 3 and _KEYS.issuperset(word) else ()
    return (word, "~" + word[-3:], *keys) if len(word) > 3 else (word, *keys)


def read(text: str | None, tokens=word_tokens) -> list[tuple[set, int, float, int]]:
    """(features, slots, weight as a positive at the start: 1 is trusted, content) of each passage of a message's own text; equal passages count once.

    tokens gives the features of a word. content is 2 for body text long enough to be a message's content, 1 for other body text, else 0.
    """
    passages: list[Passage] = []
    seen: set[str] = set()
    for part in own_paragraphs(text):
        after: tuple[str, ...] = ()
        for paragraph in part:
            p = Passage(paragraph, after)
            after = p.announces()
            if (p.kind == "short" and p.low in ("link", "click")) or p.text in seen:
                continue
            seen.add(p.text)
            passages.append(p)
    body = [p for p in passages if p.kind in ("body", "short")]
    spoken = any(p.kind in ("greeting", "closing") for p in passages)
    slot_record = any(p.slots and not p.after and p.kind in ("greeting", "closing") and len(p.words) - p.slots <= 5 for p in passages)
    shaped_record = any(p.shapes and not p.after and p.kind in ("greeting", "closing") and len(p.words) - p.shapes <= 5 for p in passages)
    total = sum(p.size for p in body)
    alone = bool(body) and not spoken and not any(p.slots or p.shapes or p.code for p in body)
    bare = alone and body[0].says() and total <= BARE_WORDS
    suspect = alone and total <= SHORT_WORDS
    filler = {id(p) for p in body if p.filler()}
    plain = sum(p.kind == "body" and p.size >= 6 and not (p.slots or id(p) in filler or p.says()) for p in body)
    out = []
    for p in passages:
        in_body = p.kind in ("body", "short")
        own = {t for w in set(p.words) for t in tokens(w)}
        if id(p) in filler:
            own.update(tokens("¶filler¶"))
        own.update(tokens(f"¶{p.kind}¶"))
        for w in p.after:
            own.update(tokens(w))
        if in_body:
            own.update(tokens("¶among¶" if plain - (p.kind == "body" and p.size >= 6) > 1 else "¶spoken¶" if spoken else "¶bare¶"))
        trusted = (p.slots and slot_record) or (in_body and (bare or id(p) in filler))
        content = 2 if p.kind == "body" and p.size >= CONTENT_WORDS else int(in_body)
        half = (in_body and suspect) or (p.shapes and shaped_record)
        out.append((own, p.slots + p.shapes, 1.0 if trusted else SUSPECT if half else 0.0, content))
    return out


def passages(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of df: (key, features array<array<int>>, slots, trusted, content: an array entry per passage)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}

        def numbers(word: str) -> tuple[int, ...]:
            got = known.get(word)
            if got is None:
                got = tuple(_hash(t) for t in word_tokens(word))
                if len(known) < KNOWN_WORDS:
                    known[word] = got
            return got

        for batch in batches:
            features, slots, trusted, content = [], [], [], []
            for value in strings(batch.column(1)):
                got = read(value, numbers)
                features.append([sorted(g[0]) for g in got])
                slots.append([g[1] for g in got])
                trusted.append([g[2] for g in got])
                content.append([g[3] for g in got])
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features, pa.list_(pa.list_(i32))), *[pa.array(x, pa.list_(t)) for x, t in ((slots, i32), (trusted, pa.float32()), (content, i32))]], names=[key, "features", "slots", "trusted", "content"]
            )

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, features array<array<int>>, slots array<int>, trusted array<float>, content array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, passage of each) of a column of nested lists."""
    inner = column.flatten()
    if not len(inner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.diff(inner.offsets.to_numpy())
    return inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(inner)), lengths)


class Model:
    """Log-odds of each feature that counts and of the classes."""

    def __init__(self, features: np.ndarray, positive: np.ndarray, negative: np.ndarray, a: float, b: float, n_positive: float, n_negative: float):
        """features in order, and their counts; a and b are the counts of all features, also of those left out."""
        a, b = a + 1e-9, b + 1e-9
        # each class gets pseudo-counts in proportion to its size, so that a feature neither has seen says nothing
        weights = np.log((positive + SMOOTHING * a / (a + b)) / a) - np.log((negative + SMOOTHING * b / (a + b)) / b)
        self.features, self.weights = np.append(features, 1 << HASH_BITS), np.append(weights, 0.0)
        self.prior = float(np.log(max(n_positive, 1.0)) - np.log(max(n_negative, 1.0)))

    def scores(self, features: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.features, features)
        return self.prior + np.bincount(passage, weights=np.where(self.features[at] == features, self.weights[at], 0.0), minlength=n)


def fit(parsed: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """The model after the given rounds over all passages; None if nothing is trusted."""
    sc = parsed.sparkSession.sparkContext

    def round_of(model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float, float]:
        shared = sc.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trusted = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                features, passage = _flat(batch.column(0))
                if not len(trusted):
                    continue
                w = trusted
                if shared.value is not None:
                    z = shared.value.scores(features, passage, len(trusted))
                    w = np.where(trusted == 1, 1.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                own, at = np.unique(features, return_inverse=True)
                pos, neg = np.bincount(at, weights=w[passage], minlength=len(own)), np.bincount(at, weights=1 - w[passage], minlength=len(own))
                # -1 has the passages, -2 the sums over all features
                f, p, n = np.append(own, [-1, -2]), np.append(pos, [w.sum(), pos.sum()]), np.append(neg, [(1 - w).sum(), neg.sum()])
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(p), pa.array(n)], names=["f", "p", "n"])

        got = parsed.select("features", "trusted").mapInArrow(count, "f bigint, p double, n double").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        got = got.where(f"f < 0 or p + n > {LEAST - 0.5}").toPandas().sort_values("f")
        known, total = got[got["f"] >= 0], got.set_index("f")[["p", "n"]].reindex([-1, -2], fill_value=0.0).to_numpy()
        return known["f"].to_numpy(), known["p"].to_numpy(), known["n"].to_numpy(), *total[1], *total[0]

    model, trusted = None, (0.0, 0.0)
    for _ in range(rounds):
        *counts, n_pos, n_neg = round_of(model)
        if model is None:
            if not n_pos:
                return None
            trusted = n_pos, n_neg
        model = Model(*counts, *trusted)  # the prior stays that of the trusted, or the positives would spread to greetings
    return model


def scored(parsed: DataFrame, key: str, model: Model | None) -> DataFrame:
    """(key, n_passages, n_residue, n_ordinary, best_score, found) of every row; found is the record's decision."""
    kind = parsed.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_passages int, n_residue int, n_ordinary int, best_score double, found boolean"
    if model is None:
        return parsed.select(F.col(f"`{key}`"), F.size("slots").alias("n_passages"), F.lit(0).alias("n_residue"), F.lit(0).alias("n_ordinary"), F.lit(None).cast("double").alias("best_score"), F.lit(False).alias("found"))
    shared = parsed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
            slots, content, n = flat[0], flat[2], len(flat[0])
            features, passage = _flat(batch.column(1))
            z = shared.value.scores(features, passage, n)
            counts = np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)
            add = lambda x: np.bincount(row, weights=x, minlength=len(counts)).astype(np.int32)  # noqa: B023, E731
            residue, plain = z > CUT, (z <= CUT) & (content == 2)
            in_text, other = add(residue & (slots > 0)), add(residue & (content > 0) & (slots == 0))
            best = pd.Series(z).groupby(row).max().reindex(range(len(counts))).to_numpy()
            found = (in_text > 0) | ((other > 0) & (add(plain) == 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int32)), pa.array(add(residue)), pa.array(add(plain)), pa.array(best, from_pandas=True), pa.array(found)],
                names=[key, "n_passages", "n_residue", "n_ordinary", "best_score", "found"],
            )

    return parsed.mapInArrow(run, schema)


def decide(df: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """scored() of every row of df by the model learned from df."""
    parsed = checkpointed(passages(df, key, text))
    return scored(parsed, key, fit(parsed, rounds))


def residue(df: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """The keys of the rows found."""
    return decide(df, key, text, rounds).where("found").select(F.col(f"`{key}`"))
