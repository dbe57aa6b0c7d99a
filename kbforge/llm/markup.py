"""Markup residue: boosted trees over the nodes of a text's markup tree, and conversion to clean text.

A text is parsed to a tree: candidate HTML, Markdown, wiki and LaTeX constructs are nodes, nested by their extents. Every node gets
features of itself, its subtree, its attributes and its siblings, and boosted trees give the odds that it is markup rather than
signs used as themselves. Decoding goes from ancestors to descendants: what lies in an accepted code or verbatim
container is text, and a node whose closing partner is rejected is rejected with it, so that no decisions contradict each other.

The trees are fitted on a bounded sample of rows labelled by `label` (at most SAMPLE_DOCUMENTS documents, see `fit_model`).

Defined results: null and empty texts hold no markup and convert to themselves; source and configuration files (by the
suffix of file_path) are no cases and stay as they are; a null file_path counts as a text file; repeated rows give the same; very long texts
are parsed whole.
"""

from __future__ import annotations

import html
import html.entities
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.gbt import Trees, fit

SAMPLE_DOCUMENTS = 4_000
MODEL = os.path.join(os.path.dirname(__file__), "models", "markup_trees.npz")
CODE_SUFFIX = r"\.(py|ts|js|sh|json|ya?ml)$"
# Names of HTML elements and frequent LaTeX commands.
HTML_NAMES = frozenset("a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video".split())
TEX_NAMES = frozenset("documentclass begin end section subsection subsubsection chapter paragraph item cite ref label textbf textit emph texttt footnote url href usepackage title author maketitle caption frac sum alpha beta le ge sqrt underline includegraphics tableofcontents bibliography verb text mathbb mathcal left right cdot times hline".split())
PYTHON_NAMES = frozenset("init main name file all doc version dict class call str repr new del len iter next enter exit getattr setattr eq hash".split())
# (family, kind, substrings of which one must occur, pattern). Group 1 is the inner text, group "n" a name.
KINDS = [
    ("html", "comment", ["<!"], r"<!--(.*?)-->|<!DOCTYPE[^<>]*()>"),
    ("html", "pre", ["<pre", "<PRE"], r"(?i)<(?P<n>pre|script|style)\b[^<>]*>(.*?)</(?P=n)>"),
    ("html", "tag", ["<"], r"</?(?P<n>[a-zA-Z][a-zA-Z0-9]*)(\s[^<>]*)?/?>"),
    ("html", "entity", ["&"], r"&(?P<n>[a-zA-Z]{2,8}|#\d{2,5}|#[xX][0-9a-fA-F]{2,5});()"),
    ("md", "fence", ["```", "~~~"], r"(?ms)^ {0,3}(?P<n>```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}(?P=n)[ \t\r]*$|\Z)"),
    ("md", "front", ["---"], r"(?m)\A---[ \r]*\n((?:[\w-]+:[^\n]*\n(?:[ -][^\n]*\n)*)+)---[ \r]*$"),
    ("md", "heading", ["#"], r"(?m)^ {0,3}(#{1,6})[ \t]+\S[^\n]*$"),
    ("md", "setext", ["\n==", "\n--"], r"(?m)^([^\s|>#*+-][^\n]*)\n(?:={3,}|-{4,})[ \r]*$"),
    ("md", "link", ["]("], r"!?\[((?:[^\[\]\n]|!\[[^\[\]\n]*\]\([^)\n ]*\))*)\]\([^)\n ]+(?: +\"[^\"\n]*\")?\)"),
    ("md", "reference", ["]"], r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]|(?m:^\[([^\[\]\n]+)\]: +\S+)|\[\^[^\[\]\n]+\]"),
    ("md", "strong", ["**", "__"], r"\*\*(?=\S)([^*\n]*?\S)\*\*(?!\*)|(?<![\w_])__(?=\S)([^_\n]*?\S)__(?!\w)"),
    ("md", "emphasis", ["*", "_"], r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])"),
    ("md", "strike", ["~~"], r"~~(?=\S)([^~\n]*?\S)~~"),
    ("md", "code", ["`"], r"(?<!`)`([^`\n]+)`(?!`)"),
    ("md", "table", ["---"], r"(?m)^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t\r]*$()"),
    ("md", "quote", [">"], r"(?m)^ {0,3}(>)[ \t]?\S[^\n]*$"),
    ("md", "task", ["[ ]", "[x]", "[X]"], r"(?m)^[ \t]*[-*+] (\[[ xX]\]) "),
    ("tex", "display", ["$$", "\\["], r"\$\$([^$]+)\$\$|\\\[((?:[^\\]|\\(?![\[\]]))+)\\\]"),
    ("tex", "inline", ["$"], r"(?<![\\$\w])\$(?=\S)([^$\n]+?)(?<=\S)\$(?![\w$])"),
    ("tex", "verbatim", ["\\begin"], r"(?s)\\begin\{(?P<n>verbatim|lstlisting|minted)\}(.*?)\\end\{(?P=n)\}"),
    ("tex", "command", ["\\"], r"\\(?P<n>[a-zA-Z]{2,})\*?(?=[^a-zA-Z]|$)(\{(?:[^{}\n]|\n(?!\s*\n))*\}|\[[^\[\]\n]*\])?(?:\{(?:[^{}\n]|\n(?!\s*\n))*\})*"),
    ("wiki", "heading", ["=="], r"(?m)^(={2,6}) ?[^=\n]+? ?\1[ \t\r]*(?:$| )"),
    ("wiki", "hn", ["h1.", "h2.", "h3.", "h4."], r"(?m)^(h[1-6])\. \S[^\n]*$"),
    ("wiki", "link", ["[["], r"\[\[([^\[\]\n]+)\]\]"),
    ("wiki", "template", ["{{"], r"\{\{([^{}]+)\}\}|\{\{([^{}\n]+)$"),
    ("wiki", "quotes", ["''"], r"''+(?=\S)([^'\n]+?)''+"),
    ("wiki", "table", ["||", "{|", "|-", "|}"], r"(?m)^\|\|[^\n]*\|\|[ \r]*$()|^\{\|[^\n]*$|^\|[-}][^\n]*$"),
    ("wiki", "macro", ["{"], r"(?s)\{(?P<n>code|noformat)(?::[^{}\n]*)?\}(.*?)\{(?P=n)\}|\{(?:color|quote|panel|info|note|warning)(?::[^{}\n]*)?\}()"),
    ("wiki", "external", ["[http", "|http"], r"\[https?://[^\s\]]+ ([^\]\n]+)\]|\[([^\]|\n]+)\|https?://[^\]\n]+\]"),
    ("wiki", "row", ["|"], r"(?m)^\|(?![-|}])([^\n|]+\|[^\n]*)\|[ \r]*$"),
]
NAMES = [f"{a}_{b}" for a, b, *_ in KINDS]
_COMPILED = [(i, subs, re.compile(p)) for i, (_, _, subs, p) in enumerate(KINDS)]
FAMILIES = ["html", "md", "tex", "wiki"]
_FAMILY = [FAMILIES.index(k[0]) for k in KINDS]
_CONTAINER = frozenset(i for i, n in enumerate(NAMES) if n in ("html_comment", "html_pre", "md_fence", "md_code", "tex_verbatim", "wiki_macro", "md_front", "tex_display"))
N_FEATURES = 20


class Node:
    __slots__ = ("kind", "start", "end", "a", "b", "name", "parent", "depth")

    def __init__(self, kind: int, start: int, end: int, a: int, b: int, name: str) -> None:
        self.kind, self.start, self.end, self.a, self.b, self.name, self.parent, self.depth = kind, start, end, a, b, name, -1, 0


def parse(text: str) -> list[Node]:
    """Candidate nodes in text order, nested by extents; of equal starts the longer comes first."""
    nodes = []
    for i, subs, pattern in _COMPILED:
        if not any(s in text for s in subs):
            continue
        for m in pattern.finditer(text):
            g = next((k for k in range(1, (m.lastindex or 0) + 1) if m.start(k) >= 0 and k != pattern.groupindex.get("n")), 0)
            nodes.append(Node(i, m.start(), m.end(), m.start(g), m.end(g), (m["n"] or "") if "n" in pattern.groupindex else ""))
    nodes.sort(key=lambda x: (x.start, -x.end, x.kind))
    stack: list[int] = []
    for j, x in enumerate(nodes):
        while stack and nodes[stack[-1]].end <= x.start:
            stack.pop()
        if stack and nodes[stack[-1]].end >= x.end:
            x.parent = stack[-1]
            x.depth = nodes[stack[-1]].depth + 1
        if not stack or nodes[stack[-1]].end >= x.end:
            stack.append(j)
    return nodes


def _char(text: str, i: int) -> float:
    if not 0 <= i < len(text):
        return 0.0
    c = text[i]
    return 1.0 if c == "\n" else 2.0 if c.isspace() else 3.0 if c.isdigit() else 4.0 if c.isalpha() else 5.0


def node_features(text: str, nodes: list[Node], md_suffix: bool, only: list[int] | None = None) -> np.ndarray:
    """Features of the nodes, or of those whose places are given in `only`."""
    places = range(len(nodes)) if only is None else only
    x = np.zeros((len(places), N_FEATURES))
    if not len(places):
        return x
    kinds = Counter(n.kind for n in nodes)
    families = Counter(_FAMILY[n.kind] for n in nodes)
    distinct = Counter(_FAMILY[k] for k in kinds)
    names = Counter((n.kind, n.name.lower()) for n in nodes if n.name)
    children, child_chars, siblings = Counter(), Counter(), Counter()
    for n in nodes:
        children[n.parent] += 1
        child_chars[n.parent] += n.end - n.start
        siblings[(n.parent, n.kind)] += 1
    closing = {n.name.lower() for n in nodes if NAMES[n.kind] == "html_tag" and text.startswith("</", n.start)}
    size = max(1, len(text))
    for r, j in enumerate(places):
        n = nodes[j]
        inner = text[n.a : n.b]
        attrs = len(inner.split()) if NAMES[n.kind] in ("html_tag", "tex_command") else inner.count("|") + inner.count(":")
        span = n.end - n.start
        letters = sum(map(str.isalpha, inner))
        known = n.name.lower() in HTML_NAMES if NAMES[n.kind] == "html_tag" else n.name in TEX_NAMES if NAMES[n.kind] == "tex_command" else n.name[:1] == "#" or n.name.lower() in html.entities.name2codepoint if NAMES[n.kind] == "html_entity" else not (text[n.start] == "_" and inner in PYTHON_NAMES) if NAMES[n.kind] == "md_strong" else True
        x[r] = (
            n.kind, _FAMILY[n.kind], np.log1p(span), len(inner) / max(1, span), np.log1p(attrs), n.depth, np.log1p(siblings[(n.parent, n.kind)]),
            np.log1p(kinds[n.kind]), np.log1p(families[_FAMILY[n.kind]]), distinct[_FAMILY[n.kind]], _char(text, n.start - 1), _char(text, n.end),
            float(known), float(n.name.lower() in closing), float(bool(re.fullmatch(r"\w*", inner))), letters / max(1, len(inner)),
            float(bool(re.search(r"[\\^{}=+]|\w\(", inner))), np.log1p(children[j]) + child_chars[j] / max(1, span), float(md_suffix), np.log1p(1000 * kinds[n.kind] / size),
        )
        if n.start and text[n.start - 1] == ":":
            x[r, 10] = 6.0
    return x


def label(text: str, n: Node) -> bool:
    """Weak label of a node, from its own signs and neighbours; used for fitting only."""
    kind, inner = NAMES[n.kind], text[n.a : n.b]
    before = text[n.start - 1] if n.start else "\n"
    if kind == "html_tag":
        return n.name.lower() in HTML_NAMES and not (before.isalnum() or before in "_:")
    if kind == "html_entity":
        return n.name[0] == "#" or n.name.lower() in html.entities.name2codepoint
    if kind == "md_strong":
        return not (text[n.start] == "_" and inner in PYTHON_NAMES)
    if kind == "md_emphasis":
        return not (text[n.start] == "_" and re.search(r"[/.(]", inner)) and not re.fullmatch(r"[\d\s=+.]+", inner)
    if kind == "tex_inline":
        return bool(re.search(r"[\\^_{}=<>+]|[a-zA-Z]\(|^[a-zA-Z]$", inner)) and not re.match(r"\d+(?:[.,]\d+)? [a-z]", inner)
    if kind == "tex_command":
        return n.name in TEX_NAMES and not (before.isalnum() or before in ":\\/\"'.") or text[n.end - 1] == "}" and before != ":" and not before.isalnum()
    if kind == "md_heading":
        follow = text[n.end : n.end + 2]
        return before == "\n" and (follow.strip(" \r") in ("", "\n") or follow.startswith(("\n\n", "\n\r"))) or n.start == 0
    if kind == "wiki_template":
        return bool(re.match(r"[A-Za-z#!/]", inner)) and not re.search(r"[()]", inner)
    if kind == "md_reference":
        return not re.search(r"\w\[", text[max(0, n.start - 1) : n.start + 1]) and not re.fullmatch(r"\d+\]\[\d+", text[n.start + 1 : n.end - 1])
    return True


@lru_cache(maxsize=1)
def model(path: str = MODEL) -> Trees:
    return Trees.load(path)


def decode(text: str, nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Accepted nodes: ancestors first; inside an accepted container everything is text, and closing tags follow their opening tags."""
    keep = odds > 0
    inside = np.zeros(len(nodes), dtype=bool)
    open_tags = {n.name.lower() for j, n in enumerate(nodes) if keep[j] and NAMES[n.kind] == "html_tag" and not text.startswith("</", n.start)}
    for j, n in enumerate(nodes):
        if n.parent >= 0 and (inside[n.parent] or keep[n.parent] and nodes[n.parent].kind in _CONTAINER):
            inside[j] = True
            keep[j] = False
        elif NAMES[n.kind] == "html_tag" and text.startswith("</", n.start):
            keep[j] = n.name.lower() in open_tags or keep[j] and n.name.lower() in HTML_NAMES
    return keep.tolist()


def decisions(texts: list[str], md: list[bool]) -> list[tuple[list[Node], list[bool]]]:
    """Nodes and decisions of many texts with one evaluation of the trees."""
    parsed = [parse(t) for t in texts]
    feats = [node_features(t, ns, m) for t, ns, m in zip(texts, parsed, md, strict=True)]
    odds = model().predict(np.concatenate(feats)) if sum(map(len, feats)) else np.zeros(0)
    out, at = [], 0
    for t, ns in zip(texts, parsed, strict=True):
        out.append((ns, decode(t, ns, odds[at : at + len(ns)])))
        at += len(ns)
    return out


def holds_markup(texts: list[str], md: list[bool], first: int = 6) -> list[bool]:
    """Whether each text has an accepted node. A top-level opening node decides for itself, so a few of those are
    evaluated first; texts in which none is accepted are decoded in full. The answer is that of `decisions`."""
    parsed = [parse(t) for t in texts]
    tops = [[j for j, n in enumerate(ns) if n.parent < 0 and not t.startswith("</", n.start)][:first] for t, ns in zip(texts, parsed, strict=True)]
    out = np.zeros(len(texts), dtype=bool)
    for full in (False, True):
        todo = [i for i in range(len(texts)) if not out[i] and parsed[i]]
        feats = [node_features(texts[i], parsed[i], md[i], None if full else tops[i]) for i in todo]
        odds = model().predict(np.concatenate(feats)) if sum(map(len, feats)) else np.zeros(0)
        at = 0
        for i, f in zip(todo, feats, strict=True):
            mine = odds[at : at + len(f)]
            out[i] = any(decode(texts[i], parsed[i], mine)) if full else (mine > 0).any()
            at += len(f)
    return out.tolist()


_BLOCK_TAGS = frozenset("p div ul ol table tr section article header footer blockquote br hr h1 h2 h3 h4 h5 h6 pre dl figure html head body title".split())


# LaTeX commands that are parts of formulas, and those whose arguments are no text.
TEX_FORMULA = frozenset("frac sum prod int alpha beta gamma delta lambda mu sigma theta pi le ge leq geq neq sqrt mathbb mathcal mathrm left right cdot times infty partial approx to in".split())
TEX_SILENT = frozenset("documentclass usepackage begin end label ref eqref cite pageref includegraphics bibliography bibliographystyle input include maketitle tableofcontents hline newpage vspace hspace setlength pagestyle".split())


def _template(inner: str) -> str:
    """The arguments of a wiki template: unnamed ones one after the other, named ones as "name: value"."""
    args = [a.strip() for a in inner.split("|")[1:]]
    named = [re.match(r"([\w .-]+?)\s*=\s*(.*)", a, re.S) for a in args]
    plain = " ".join(a for a, m in zip(args, named, strict=True) if a and not m)
    pairs = [f"{m[1]}: {m[2].strip()}" for m in named if m and m[2].strip()]
    return ("\n" if "\n" in inner else ", ").join([*([plain] if plain else []), *pairs])


def _render(text: str, n: Node) -> str:
    """Replacement of an accepted node; headings, lists, code and formulas keep a plain Markdown form."""
    kind, inner, raw = NAMES[n.kind], text[n.a : n.b], text[n.start : n.end]
    name = n.name.lower()
    if kind == "html_tag":
        closing = raw.startswith("</")
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "code":
            return "`"
        if name == "img":
            alt = re.search(r"""(?i)\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", raw)
            return html.unescape(next(x for x in alt.groups() if x is not None)) if alt else ""
        return "\n" if name in _BLOCK_TAGS else ""
    if kind == "html_entity":
        return html.unescape(raw)
    if kind == "html_pre":
        m = re.match(r"<[^<>]*>(.*)</", raw, re.S)
        body = html.unescape(re.sub(r"</?code[^<>]*>", "", m[1])) if m else ""
        return "\n```\n" + body.strip("\n") + "\n```\n" if name == "pre" else ""
    if kind in ("html_comment", "md_table"):
        return ""
    if kind == "md_front":
        return inner
    if kind == "wiki_template":
        return _template(inner)
    if kind == "wiki_table":
        return " | ".join(c.strip() for c in raw.strip("|\r ").split("||")) if raw.startswith("||") else ""
    if kind == "md_fence":
        return raw
    if kind in ("tex_verbatim", "wiki_macro"):
        body = re.sub(r"\A(?:\\begin\{\w+\}|\{[^{}]*\})(.*?)(?:\\end\{\w+\}|\{\w+\})\Z", r"\1", raw, flags=re.S)
        return "" if body == raw else "\n```\n" + body.strip("\n") + "\n```\n"
    if kind == "md_setext":
        return "# " + inner.strip()
    if kind == "md_heading":
        return raw
    if kind in ("wiki_heading", "wiki_hn"):
        return "#" * (int(inner[1]) if kind == "wiki_hn" else len(inner)) + " " + (raw[4:] if kind == "wiki_hn" else raw.strip("= \r"))
    if kind == "wiki_link":
        return inner.rpartition("|")[2]
    if kind == "md_reference":
        return inner if raw.endswith("]") and not raw.startswith("[^") else ""
    if kind in ("md_quote", "md_task"):
        return raw.replace("[ ] ", "").replace("[x] ", "").replace("[X] ", "") if kind == "md_task" else raw.lstrip(" >")
    if kind in ("tex_inline", "tex_display", "md_code"):
        return raw
    if kind == "tex_command":
        args = re.findall(r"\{([^{}]*)\}", raw)
        depth = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3}.get(n.name)
        if depth:
            return "#" * depth + " " + "".join(args[:1])
        if n.name == "item":
            return " ".join(["-", *args])
        if n.name in TEX_FORMULA:
            return raw
        return "" if n.name in TEX_SILENT else args[-1] if args else ""
    return inner


def clean(text: str, nodes: list[Node], keep: list[bool]) -> str:
    out, at = [], 0
    for n, ok in zip(nodes, keep, strict=True):
        if not ok or n.start < at:
            continue
        out.append(text[at : n.start])
        piece = _render(text, n)
        kind = NAMES[n.kind]
        if kind in ("md_heading", "md_quote", "md_setext", "wiki_heading", "wiki_hn", "md_strong", "md_emphasis", "md_strike", "wiki_quotes", "md_link", "wiki_row"):
            piece = re.sub(r"</?[a-zA-Z][^<>]*>", "", html.unescape(piece))
            piece = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1", re.sub(r"(\*\*|~~|'''?)(\S.*?)\1", r"\2", piece))
        out.append(piece)
        at = n.end
    out.append(text[at:])
    return re.sub(r"\n[ \t]*\n[ \t]*\n\s*", "\n\n", "".join(out)).strip()


def fit_model(rows: list[tuple[str, str | None]], path: str = MODEL) -> Trees:
    """Fit and store the trees on (text, file_path) rows; only the first SAMPLE_DOCUMENTS are used."""
    xs, ys = [], []
    sample = list(rows[:SAMPLE_DOCUMENTS])
    # Short cuttings around some nodes, so that the trees also see texts that hold a single sign.
    for text, file_path in rows[:SAMPLE_DOCUMENTS]:
        for n in parse(text)[::9][:4]:
            sample.append((text[max(0, n.start - 40) : n.end + 40], file_path))
    for text, file_path in sample:
        nodes = parse(text)
        xs.append(node_features(text, nodes, (file_path or "").endswith(".md")))
        ys += [label(text, n) for n in nodes]
    trees = fit(np.concatenate(xs), np.array(ys, dtype=float), rounds=60)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    trees.save(path)
    model.cache_clear()
    return trees


def _own(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.lower("file_path").rlike(CODE_SUFFIX), F.lit(False)))


def found(docs: DataFrame) -> DataFrame:
    """doc_id of documents (doc_id, text, file_path) that hold markup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = holds_markup(pdf["text"].tolist(), [p is not None and p.endswith(".md") for p in pdf["file_path"]])
            yield pdf.loc[got, ["doc_id"]]

    return _own(docs).where("text is not null").select("doc_id", "text", "file_path").mapInPandas(run, "doc_id long")


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text): clean text of every document; source and configuration files and null texts as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code = [bool(p and re.search(CODE_SUFFIX, p.lower())) for p in pdf["file_path"]]
            texts = [t if t is not None and not c else "" for t, c in zip(pdf["text"], code, strict=True)]
            got = decisions(texts, [bool(p and p.endswith(".md")) for p in pdf["file_path"]])
            new = [clean(t, *g) if t and any(g[1]) else old for t, old, g in zip(texts, pdf["text"], got, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": new})

    return docs.select("doc_id", "text", "file_path").mapInPandas(run, "doc_id long, text string")
