"""Cards of evidence out of text that is nearly YAML: one pass that drops lines to a ledger, never a card."""

from __future__ import annotations

import json
import re

try:
    import yaml

    LOADER = getattr(yaml, "CBaseLoader", yaml.BaseLoader)
except ImportError:  # then every chunk is read by lines
    yaml = LOADER = None

_KEY = re.compile(r"""(?P<k>"[^"]*"|'[^']*'|[^\s\-:#\[\]{},&*!|>'"%@`][^:\[\]{}"]{0,60}?|-[^\s:][^:]{0,60}?)\s*:(?:\s+(?P<v>.*))?$""")
_INLINE = re.compile(r"(?P<k>[A-Za-z_]\w*)\s*:\s+(?P<v>\S.*)$", re.ASCII)
_BLOCK = re.compile(r"[|>][-+\d]*\s*(?:#.*)?$")
_CARD_KEY = re.compile(r"""(?m)^[ \t]*(?:-[ \t]+)?["']?(?:tipo|titolo)["']?[ \t]*:""", re.I)
_CARD_KEYS = ("tipo", "titolo")


_QUOTED = {"'": re.compile(r"'((?:[^']++|'')*+)'"), '"': re.compile(r'"((?:[^"\\]++|\\.)*+)"', re.S)}
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


class _Flow:
    """A value in brackets or quotes; raises ValueError where it is not closed."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def _space(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, stops: str = ""):
        c = self._space()
        if c in ("[", "{"):
            self.at += 1
            return self._items("]" if c == "[" else "}")
        if c and c in "'\"":
            return self._quoted(c)
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return " ".join(self.text[start : self.at].split())

    def _quoted(self, mark: str) -> str:
        m = _QUOTED[mark].match(self.text, self.at)
        if not m:
            raise ValueError(f"no closing {mark}")
        self.at = m.end()
        if mark == "'":
            return m[1].replace("''", "'")
        return _ESCAPE.sub(lambda e: chr(int(e[1], 16)) if e[1] else _NAMED.get(e[2], e[2]), m[1])

    def _items(self, close: str):
        found: list | dict = [] if close == "]" else {}
        while True:
            c = self._space()
            if not c:
                raise ValueError(f"no closing {close}")
            if c in close + ",":
                self.at += 1
                if c == close:
                    return found
                continue
            if c in "]}":
                raise ValueError(f"{c} where {close} is due")
            key = self.value(",:[]{}" if close == "}" else ",[]{}")
            if close == "]":
                found.append(key)
            elif self._space() == ":":
                self.at += 1
                found[str(key)] = self.value(",[]{}")
            else:
                found[str(key)] = ""

    def first(self) -> tuple[object, int]:
        """The value at the start, and how many lines it takes; what follows on its last line can only be a comment."""
        found = self.value()
        rest = self.text[self.at :].split("\n", 1)[0].strip()
        if rest and not rest.startswith("#"):
            raise ValueError(f"text after the closing of {self.text[:1]}")
        return found, self.text.count("\n", 0, self.at) + 1


class _Lines:
    """The tree of a chunk by margins, and the lines that have no place in it, with their reason."""

    def __init__(self, text: str) -> None:
        self.lines = text.replace("\t", "  ").split("\n")
        self.dropped: list[tuple[int, str, str]] = []
        self.root: list = []  # what stands at the margin: maps and lists one after the other
        self.open: list[tuple[int, dict | list, str | None]] = []  # margin, container, last key of a map
        at = 0
        while at < len(self.lines):
            at = self._line(at)

    def _drop(self, at: int, reason: str) -> None:
        self.dropped.append((at + 1, reason, self.lines[at].strip()))

    def _line(self, at: int) -> int:
        line = self.lines[at]
        bare = line.strip()
        margin = len(line) - len(line.lstrip(" "))
        if not bare or bare.startswith("#") or bare in ("---", "..."):
            return at + 1
        if bare.startswith("|"):
            self._table(at, bare)
            return at + 1
        items = 0
        while bare == "-" or bare.startswith("- "):
            self._item(margin)
            items += 1
            rest = bare[1:].lstrip()
            margin, bare = margin + len(bare) - len(rest), rest
        if not bare:
            return at + 1
        m = _KEY.match(bare)
        if m:
            return self._pair(at, margin, m["k"].strip("'\" "), (m["v"] or "").strip())
        if items:
            return self._scalar_item(at, margin, bare)
        if bare[0] in "[{" and not self.open:
            value, after = self._value(at, margin - 1, bare)
            if not isinstance(value, str):
                self.root.append(value)
            return after
        if self._continued(margin, bare):
            return at + 1
        self._drop(at, "neither key, item nor table")
        return at + 1

    def _close(self, margin: int, item: bool) -> None:
        """Close what lies right of the margin; an item stays in a list at its own margin, a key leaves that list."""
        while self.open and (self.open[-1][0] > margin or self.open[-1][0] == margin and (isinstance(self.open[-1][1], list) != item)):
            self.open.pop()

    def _put(self, value, margin: int) -> None:
        """value where the margin says: into the open list or the open key, else at the root."""
        if self.open:
            _, inside, key = self.open[-1]
            if isinstance(inside, list):
                inside.append(value)
                return
            if key is not None and inside.get(key) in ("", None):
                inside[key] = value
                return
        self.root.append(value)

    def _item(self, margin: int) -> None:
        # An item at the margin of the key above belongs to that key, one at a wrong margin to the nearest list.
        while self.open and self.open[-1][0] > margin:
            self.open.pop()
        if self.open and self.open[-1][0] == margin and isinstance(self.open[-1][1], dict):
            key = self.open[-1][2]
            if key is None or self.open[-1][1].get(key) not in ("", None):
                self.open.pop()
        if not (self.open and isinstance(self.open[-1][1], list)):
            found: list = []
            self._put(found, margin)
            self.open.append((margin, found, None))

    def _pair(self, at: int, margin: int, key: str, raw: str) -> int:
        self._close(margin, False)
        inside = self.open[-1][1] if self.open else None
        new = not isinstance(inside, dict) or margin > self.open[-1][0] and inside.get(self.open[-1][2]) in ("", None)
        if not new and key.lower() in _CARD_KEYS and key in inside and not any(k in inside for k in ("meta", "sezioni")):
            self._drop(at, "repeated key: taken as a new card")
            base = self.open.pop()[0]
            new = True
            self.open = [x for x in self.open if x[0] <= base]
            if self.open and isinstance(self.open[-1][1], dict):
                self.open = []
        if new:
            found: dict = {}
            self._put(found, margin)
            self.open.append((margin, found, None))
        base, inside, _ = self.open[-1]
        self.open[-1] = (base, inside, key)
        inside[key], after = self._value(at, margin, raw)
        return after

    def _scalar_item(self, at: int, margin: int, raw: str) -> int:
        value, after = self._value(at, margin - 1, raw)
        self._put(value, margin)
        return after

    def _value(self, at: int, margin: int, raw: str):
        """The value that starts with raw on line at, and the line after it; what is not closed stays as its text."""
        if _BLOCK.match(raw):
            return self._block(at + 1, margin)
        if raw[:1] in ("[", "{", "'", '"'):
            after = at + 1
            while after < len(self.lines) and self._margin(after) > margin:
                after += 1
            try:
                value, n = _Flow("\n".join([raw, *map(str.strip, self.lines[at + 1 : after])])).first()
                return value, at + n
            except ValueError as e:
                self._drop(at, f"{e}: kept as text")
                return raw, at + 1
        m = _INLINE.match(raw)
        if m:
            inner, after = self._value(at, margin, m["v"].strip())
            return {m["k"]: inner}, after
        return raw.split(" #", 1)[0].rstrip() if " #" in raw else raw, at + 1

    def _margin(self, at: int) -> int:
        line = self.lines[at]
        return len(line) - len(line.lstrip(" ")) if line.strip() else 1_000_000

    def _block(self, at: int, margin: int):
        """The lines right of the margin, and table lines wherever they stand."""
        out = []
        while at < len(self.lines) and (self._margin(at) > margin or self.lines[at].lstrip().startswith("|")):
            out.append(self.lines[at])
            at += 1
        least = min((len(x) - len(x.lstrip()) for x in out if x.strip() and not (x.lstrip().startswith("|") and len(x) - len(x.lstrip()) <= margin)), default=0)
        return "\n".join(x.lstrip() if len(x) - len(x.lstrip()) < least else x[least:] for x in out).strip("\n"), at

    def _last(self) -> tuple[dict, str] | None:
        inside, key = next(((c, k) for _, c, k in reversed(self.open) if isinstance(c, dict) and k is not None), (None, None))
        return (inside, key) if inside is not None and isinstance(inside.get(key), str) else None

    def _table(self, at: int, bare: str) -> None:
        last = self._last()
        if last and last[1].lower() not in (*_CARD_KEYS, "nome"):
            last[0][last[1]] = (last[0][last[1]] + "\n" + bare).strip()
        else:
            self._drop(at, "a table line without a field")

    def _continued(self, margin: int, bare: str) -> bool:
        """A line right of its field goes on with the field's text."""
        last = self._last()
        if not last or margin <= self.open[-1][0] or not last[0][last[1]]:
            return False
        last[0][last[1]] += " " + bare
        return True


_TABLE_BLOCK = re.compile(r"(?m)^([ ]*)(?:-[ ]+)?[\w \-]+:[ ]*[|>][-+]?[ ]*\n(?=[ ]*\|)")


def _flat(card: dict) -> dict[str, str]:
    """A card's fields as text: nested maps and lists as JSON, names in lower case."""
    text = lambda v: v.strip() if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return {str(k).strip().lower(): text(v) for k, v in card.items() if v not in ("", None)}


def _is_card(node: dict) -> bool:
    return any(str(k).strip().lower() in _CARD_KEYS for k in node)


def _walked(node, section: str, out: list[dict]) -> None:
    """Cards of a tree: maps with a tipo or titolo, under the nearest name of a section."""
    if isinstance(node, list):
        for x in node:
            _walked(x, section, out)
    elif isinstance(node, dict):
        if _is_card(node):
            card = _flat(node)
            out.append({"section": section or card.get("categoria", ""), "card": card})
            return
        low = {str(k).strip().lower(): v for k, v in node.items()}
        name = low.get("nome")
        section = name.strip() if isinstance(name, str) and name.strip() else section
        for k, v in low.items():
            if k != "meta":
                _walked(v, section, out)


def _keys(node) -> int:
    """tipo and titolo keys anywhere in a tree."""
    if isinstance(node, list):
        return sum(map(_keys, node))
    if isinstance(node, dict):
        return sum((str(k).strip().lower() in _CARD_KEYS) + _keys(v) for k, v in node.items())
    return 0


def _found(tree) -> tuple[str | None, list[dict]]:
    cards: list[dict] = []
    _walked(tree, "", cards)
    company = None
    for part in tree if isinstance(tree, list) else [tree]:
        meta = part.get("meta") if isinstance(part, dict) else None
        name = meta.get("azienda") if isinstance(meta, dict) else None
        name = name.get("nome") if isinstance(name, dict) else name
        company = company or (name.strip() if isinstance(name, str) and name.strip() else None)
    return company, cards


def parse_chunk(chunk: str) -> tuple[str | None, list[dict], list[tuple[int, str, str]], str | None]:
    """(company, cards, dropped lines, reason) of one chunk; reason tells why it gave neither company nor card, else it is null.

    YAML that loads whole is taken as it is, all scalars as strings. Else, and where a map repeats a card's key, so that
    loading would lose the first card, the chunk is read by lines in one pass: a line that fits nowhere is dropped, a
    bracket or quote left open ends with its line, and reading goes on at the next key or item of the margin. Tables
    outside of their block join it, k1: k2: v is a map in a map, and values with other colons stay text. A dropped line
    is (line from 1, reason, text).
    """
    reason = None
    if yaml is not None and not _TABLE_BLOCK.search(chunk):
        try:
            tree = yaml.load(chunk, Loader=LOADER)
            if isinstance(tree, (dict, list)) and _keys(tree) >= len(_CARD_KEY.findall(chunk)):
                company, cards = _found(tree)
                if company or cards:
                    return company, cards, [], None
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            reason = f"{getattr(e, 'problem', None) or e}" + (f" (line {mark.line + 1})" if mark else "")
    lines = _Lines(chunk)
    company, cards = _found(lines.root)
    if company or cards:
        return company, cards, lines.dropped, None
    return None, [], lines.dropped, reason or "neither company nor card"
