"""Raw HTML to flat node rows, the only step that needs a parser.

One row per form control, heading, text block, frame and title of a page.
Everything that decides something from these rows is relational
(operators/extract.py); this helper reads structure that is gone once the
page is flat: enclosing label, fieldset and form, preceding text, option lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED_TYPES = {"submit", "button", "reset", "image", "hidden"}
NATIVE = ("input", "textarea", "select")
LABELABLE = {"input", "textarea", "select", "button", "meter", "output", "progress"}
HEADINGS = {"h1", "h2", "h3", "h4", "legend"}
# an opening tag of the key ends an open element of the values
CLOSES = {
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    **{t: {"p"} for t in "p div ul ol form fieldset section article main table h1 h2 h3 h4 header footer".split()},
}
SCOPE = {"select", "ul", "ol", "table", "div", "form", "fieldset", "body", "label", "button", "dl", "section", "article"}
LABEL_CUT = 240

NODE_SCHEMA = """
page_id string, ats string, node string, pos int, tag string, attrs map<string,string>, text string,
labels_text string, for_text string, labelledby_text string, wrap_text string, near array<string>,
options array<struct<value:string,text:string>>, current string, form_key string, legend string,
container_text string, style_hidden_at int, selector string, selector_keys array<string>
"""
_OTHER_TYPES = {
    "pos": pa.int32(), "style_hidden_at": pa.int32(), "attrs": pa.map_(pa.string(), pa.string()),
    "near": pa.list_(pa.string()), "selector_keys": pa.list_(pa.string()),
    "options": pa.list_(pa.struct([("value", pa.string()), ("text", pa.string())])),
}
ARROW_SCHEMA = pa.schema(
    [
        (name, _OTHER_TYPES.get(name, pa.string()))
        for name in (
            "page_id ats node pos tag attrs text labels_text for_text labelledby_text wrap_text near options "
            "current form_key legend container_text style_hidden_at selector selector_keys"
        ).split()
    ]
)
BATCH_ROWS = 5000


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "pos", "end", "place", "kids", "holds_control", "before")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, pos: int):
        self.tag, self.attrs, self.parent, self.pos, self.end = tag, attrs, parent, pos, pos
        self.children: list[Element | str] = []
        # element children, place among them, and whether a native control is inside
        self.kids: list[Element] = []
        self.place, self.holds_control = 0, False
        # for each child the text before it, made when first asked for
        self.before: dict[int, str] | None = None

    def elements(self) -> Iterator[Element]:
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            el = stack.pop()
            yield el
            stack.extend(c for c in reversed(el.children) if isinstance(c, Element))

    def text(self, without: tuple[str, ...] = ()) -> str:
        out: list[str] = []
        stack: list[Element | str] = list(reversed(self.children))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in without:
                stack.extend(reversed(part.children))
        return "".join(out)

    def closest(self, tag: str) -> Element | None:
        el: Element | None = self
        while el is not None and el.tag != tag:
            el = el.parent
        return el

    def text_before(self, child: Element) -> str:
        """Collapsed text of the children before one, without those that hold controls, up to LABEL_CUT."""
        if self.before is None:
            self.before, so_far = {}, ""
            for part in self.children:
                if isinstance(part, Element):
                    self.before[part.place] = so_far
                    if part.holds_control:
                        continue
                    part = part.text() if len(so_far) < LABEL_CUT else ""
                if len(so_far) < LABEL_CUT:
                    so_far = squeeze(f"{so_far} {part}")[:LABEL_CUT]
        return self.before[child.place]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.current = Element("#root", {}, None, -1)
        self.count = 0

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, ())
        el = self.current
        while ends and el.parent is not None and (el.tag in ends or el.tag not in SCOPE):
            if el.tag in ends:
                self.current = el.parent
            el = el.parent
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        new = Element(tag, seen, self.current, self.count)
        self.count += 1
        new.place = len(self.current.kids)
        self.current.kids.append(new)
        self.current.children.append(new)
        if tag not in VOID:
            self.current = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        el = self.current.closest(tag)
        if el is not None and el.parent is not None:
            self.current = el.parent

    def handle_data(self, data):
        self.current.children.append(data)


def squeeze(s: str) -> str:
    return " ".join(s.split())


def _css(s: str) -> str:
    return re.sub(r"([^a-zA-Z0-9_-])", r"\\\1", s)


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"')


def _is_control(el: Element) -> bool:
    if el.tag == "input":
        return el.attrs.get("type", "text").lower() not in SKIPPED_TYPES
    return (
        el.tag in ("textarea", "select")
        or el.attrs.get("role") in ("combobox", "listbox")
        or el.attrs.get("contenteditable") in ("", "true")
    )


def _selectors(el: Element) -> tuple[str, list[str]]:
    """The preferred selector and every simpler spelling that may name this element."""
    keys = []
    if el.attrs.get("id"):
        keys.append(f"#{_css(el.attrs['id'])}")
    name = el.attrs.get("name")
    grouped = el.tag == "input" and el.attrs.get("type", "").lower() in ("radio", "checkbox")
    if name:
        bare = f'{el.tag}[name="{_quoted(name)}"]'
        if grouped and "value" in el.attrs:
            keys.append(f'{bare}[value="{_quoted(el.attrs["value"])}"]')
        if not grouped:
            keys.append(bare)
    path: list[str] = []
    cur = el
    while cur.parent is not None and cur.parent.tag != "#root" and len(path) < 8:
        path.insert(0, f"{cur.tag}:nth-child({cur.place + 1})")
        if cur.parent.attrs.get("id"):
            path.insert(0, f"#{_css(cur.parent.attrs['id'])}")
            break
        cur = cur.parent
    keys.append(" > ".join(path))
    if name and grouped:
        keys.append(f'{el.tag}[name="{_quoted(name)}"]')
    return keys[0], keys


def _near_texts(el: Element) -> list[str]:
    """Texts that may label the control, nearest first: inside each of four ancestors
    before the control, then up to three siblings before that ancestor."""
    out = []
    node = el
    for _ in range(4):
        parent = node.parent
        if parent is None or parent.tag == "#root":
            break
        out.append(parent.text_before(node))
        at = parent.place
        for sib in reversed(parent.parent.kids[max(0, at - 3):at]):
            if not sib.holds_control:
                out.append(squeeze(sib.text())[:LABEL_CUT])
        node = parent
    return out


def _options(el: Element, by_id: dict[str, Element]) -> list[dict] | None:
    if el.tag == "select":
        found = [
            {"value": o.attrs.get("value", squeeze(o.text())), "text": squeeze(o.text())}
            for o in el.elements() if o.tag == "option"
        ]
        return [o for o in found if o["value"] or o["text"]]
    if el.attrs.get("role") in ("combobox", "listbox"):
        ref = el.attrs.get("aria-controls", el.attrs.get("aria-owns"))
        box = by_id.get(ref) if ref else el
        found = [
            {"value": o.attrs.get("data-value", o.text().strip()), "text": o.text().strip()}
            for o in (box.elements() if box else ()) if o.attrs.get("role") == "option"
        ]
        return found or None
    return None


def _current(el: Element) -> str:
    if el.tag == "textarea":
        return el.text()
    if el.tag != "select":
        return el.attrs.get("value", "") if el.tag == "input" else el.text().strip()
    choices = [o for o in el.elements() if o.tag == "option"]
    picked = [o for o in choices if "selected" in o.attrs]
    if "multiple" in el.attrs:
        chosen = picked[:1]
    else:
        chosen = picked[-1:] or [o for o in choices if "disabled" not in o.attrs][:1]
    return chosen[0].attrs.get("value", squeeze(chosen[0].text())) if chosen else ""


def _form_key(el: Element, by_id: dict[str, Element]) -> str:
    form = by_id.get(el.attrs["form"]) if "form" in el.attrs else el.closest("form")
    if form is None or form.tag != "form":
        return "noform"
    return form.attrs.get("id") or form.attrs.get("name") or "form0"


def _style_hidden_at(el: Element) -> int | None:
    cur: Element | None = el
    for depth in range(6):
        if cur is None:
            return None
        style = re.sub(r"\s", "", cur.attrs.get("style", "").lower())
        if "display:none" in style or "visibility:hidden" in style:
            return depth
        cur = cur.parent
    return None


def _container_text(members: list[Element]) -> str:
    anc = members[0].parent
    while anc is not None:
        inside = {id(e) for e in anc.elements()}
        if all(id(m) in inside for m in members):
            return squeeze(anc.text(without=("input", "label", "select", "textarea")))[:200]
        anc = anc.parent
    return ""


def page_rows(html: str, own_ui_attr: str | None = None) -> Iterator[dict]:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    every = list(root.elements())
    for el in reversed(every):
        if el.tag in NATIVE or el.holds_control:
            el.parent.holds_control = True
    by_id: dict[str, Element] = {}
    for el in every:
        if el.attrs.get("id"):
            by_id.setdefault(el.attrs["id"], el)
    for_label: dict[str, Element] = {}
    labels_of: dict[int, Element] = {}
    for lab in (e for e in every if e.tag == "label"):
        target = lab.attrs.get("for")
        if target is not None:
            for_label.setdefault(target, lab)
            named = by_id.get(target)
        else:
            named = next((e for e in lab.elements() if e.tag in LABELABLE), None)
        if named is not None and named.tag in LABELABLE:
            labels_of.setdefault(named.pos, lab)

    def own_ui(el: Element) -> bool:
        while own_ui_attr and el is not None:
            if own_ui_attr in el.attrs:
                return True
            el = el.parent
        return False

    controls = [e for e in every if _is_control(e) and not own_ui(e)]
    groups: dict[tuple, list[Element]] = {}
    for el in controls:
        kind = el.attrs.get("type", "").lower()
        if el.tag == "input" and kind in ("radio", "checkbox") and el.attrs.get("name"):
            groups.setdefault((_form_key(el, by_id), kind, el.attrs["name"]), []).append(el)
    container_of = {
        members[0].pos: _container_text(members)
        for (_, kind, _), members in groups.items() if kind == "radio" or len(members) > 1
    }

    for el in every:
        if el.tag in HEADINGS or el.attrs.get("role") == "heading":
            yield {"node": "heading", "pos": el.pos, "text": el.text()}
        if el.tag == "title":
            yield {"node": "title", "pos": el.pos, "text": el.text()}
        elif el.tag == "iframe" and "src" in el.attrs:
            yield {"node": "iframe", "pos": el.pos, "text": el.attrs["src"]}
        names = el.attrs.get("class", "").lower()
        if (
            el.tag in ("main", "article") or "description" in names or "job-detail" in names
            or "description" in el.attrs.get("id", "").lower()
        ) and not el.holds_control and not own_ui(el):
            yield {"node": "block", "pos": el.pos, "text": el.text()}
    for el in controls:
        lab = labels_of.get(el.pos)
        own_for = for_label.get(el.attrs["id"]) if el.attrs.get("id") else None
        wrap = el.closest("label")
        fieldset = el.closest("fieldset")
        legend = next((e for e in fieldset.elements() if e.tag == "legend"), None) if fieldset else None
        selector, keys = _selectors(el)
        refs = el.attrs.get("aria-labelledby", "").split()
        yield {
            "node": "control", "pos": el.pos, "tag": el.tag, "attrs": list(el.attrs.items()),
            "labels_text": lab.text() if lab else None,
            "for_text": own_for.text() if own_for else None,
            "labelledby_text": " ".join(filter(None, (squeeze(by_id[r].text())[:LABEL_CUT] for r in refs if r in by_id))),
            "wrap_text": wrap.text(without=NATIVE) if wrap else None,
            "near": _near_texts(el), "options": _options(el, by_id), "current": _current(el),
            "form_key": _form_key(el, by_id), "legend": legend.text() if legend else None,
            "container_text": container_of.get(el.pos), "style_hidden_at": _style_hidden_at(el),
            "selector": selector, "selector_keys": keys,
        }


def node_rows(batches: Iterator[pa.RecordBatch], own_ui_attr: str | None = None) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: batches of (page_id, ats, html) to batches of node rows."""
    rows: list[dict] = []
    for batch in batches:
        for page in batch.to_pylist():
            for row in page_rows(page["html"], own_ui_attr):
                rows.append({"page_id": page["page_id"], "ats": page["ats"], **row})
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
