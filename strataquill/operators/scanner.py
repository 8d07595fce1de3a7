"""Declarations of source files by scanners: comments and strings are blanked, brackets and block words matched, heads found.

A scanner is a table entry: what comments and strings look like, heads with the kinds that they declare, and how a body
ends (braces, ``end``, indentation, or the line). Nesting comes from the spans, so a declaration knows its owner and its
last line. Everything is linear in the text but the sort of the heads.
"""

from __future__ import annotations

import bisect
import json
import re
from dataclasses import dataclass, field
from itertools import pairwise

N = r"[A-Za-z_$][\w$]*"


@dataclass
class Declaration:
    start: int
    end: int
    kind: str
    name: str
    parent: str | None = None


@dataclass
class Language:
    heads: list[tuple[str, str]]
    blanks: str
    body: str = "brace"
    owners: tuple[str, ...] = ()  # kinds whose members name them as parent
    member: str | None = None  # the kind that a function inside an owner is
    imports: str = r"(?!)"
    line_ends: bool = False  # a new line outside brackets ends a head without a body
    words: str = r"(?!)"  # block words, for bodies that end in ``end``
    keep: tuple[str, ...] = ()  # kinds that name no parent
    flags: int = re.MULTILINE
    compiled: list = field(default_factory=list)


_C = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?"
_TRIPLE = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)"
_CHAR = r"\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\[^'\n]+|[^'\\\n])'"
_HASH = r"#[^\n]*"
_REGEX = r"(?<=[=(,:;!&|?{}\n\[])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|readonly|export|default|declare|partial|synchronized|native|inline|suspend|data|inner|implicit|lazy|case|unsafe|extern|new|strictfp|transient)\s+)*"
_TYPED = r"(?:[\w$.]+(?:\s*<[^;{}()]*?>)?(?:\s*\[\s*\])*[?*&]*)"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|with|do|else|new|throw|await|typeof|delete|super|synchronized|using|lock|fixed|foreach|when|in|match|elif|sizeof|assert)\b)"

_JS_HEADS = [
    ("class", rf"\bclass\s+({N})"),
    ("function", rf"\bfunction\s*\*?\s*({N})\s*[(<]"),
    ("function", rf"\b(?:const|let)\s+({N})\s*(?::[^=;{{}}]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^<>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>|{N}\s*=>)"),
    ("method", rf"(?:^|[{{}};,])\s*{_MODS}(?:(?:get|set)\s+|\*\s*)?{_NOT}(#?{N})\s*(?:<[^<>()]*>)?\s*(?=\()"),
    ("enum", rf"\benum\s+({N})"),
]

LANGUAGES: dict[str, Language] = {
    "typescript": Language([*_JS_HEADS, ("interface", rf"\binterface\s+({N})"), ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({N})\s*(?:<[^=]*>)?\s*=")], rf"{_C}|`(?:\\[\s\S]|[^`\\])*`?|{_QUOTED}|{_REGEX}", owners=("class",), keep=("class", "interface", "type", "enum"), imports=r"^\s*(?:import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?|export\s+(?:\*|\{[^}]*\})\s*from[^\n]*)"),
    "go": Language([("function", rf"^func\s+({N})\s*[\[(]"), ("method", rf"^func\s*\([^)]*\)\s*({N})\s*\("), ("type", rf"^type\s+({N})\b"), ("type", rf"^\t({N})\s+(?=struct\b|interface\b)")], rf"{_C}|`[^`]*`?|{_QUOTED}", line_ends=True, imports=r"^import\s*(?:\([^)]*\)|[^\n]*)"),
    "java": Language([("class", rf"\bclass\s+({N})"), ("interface", rf"\binterface\s+({N})"), ("enum", rf"\benum\s+({N})"), ("method", rf"(?:^|[{{}};])\s*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^(){{}}]*>\s*)?(?:{_NOT}{_TYPED}\s+)?{_NOT}({N})\s*(?=\()")], rf"{_TRIPLE}|{_C}|{_QUOTED}", owners=("class",), keep=("interface", "enum"), imports=r"^\s*(?:import|package)\s[^;\n]*;?"),
    "rust": Language([("function", rf"\bfn\s+({N})"), ("class", rf"\bstruct\s+({N})"), ("enum", rf"\benum\s+({N})"), ("interface", rf"\btrait\s+({N})"), ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+({N})"), ("impl", r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{}]*?>)?\s+(?:[^{};]*?\bfor\s+)?([\w:]+(?:<[^{}]*>)?)")], rf"{_C}|b?r#*\"[\s\S]*?\"#*|{_CHAR}", owners=("impl",), member="method", keep=("class", "enum", "interface", "type", "impl"), imports=r"^\s*(?:pub\s+)?(?:use\s[^;]*;|extern\s+crate[^;]*;)"),
    "cpp": Language([("namespace", r"^[ \t]*(?:inline\s+)?namespace\s+([\w:]+)\s*(?=\{)"), ("class", rf"\b(?:class|struct|union)\s+(?:[A-Z_]+\s+)?({N})\s*(?:final\s*)?(?=[:{{])"), ("enum", rf"\benum\s+(?:class\s+|struct\s+)?({N})\s*(?=[:{{])"), ("type", rf"^\s*typedef\b[^;{{}}]*?\b({N})\s*(?:\[[^\]]*\])?\s*(?=;)"), ("alias", r"^\s*typedef\s+(?:struct|union|enum)\b"), ("function", rf"(?:^|[;{{}}])[ \t]*(?:template\s*<[^{{}};]*>\s*)?{_NOT}(?:[\w:<>,~&*\[\]]+[\s*&]+)*?(?:\w+(?:<[^<>(){{}};]*>)?::)*(~?{N})\s*(?=\()")], rf"{_C}|R\"\([\s\S]*?\)\"|{_CHAR}|^[ \t]*#[ \t]*(?!include)(?:\\\n|[^\n])*", keep=("class", "enum", "type", "alias", "function", "namespace"), imports=r"^[ \t]*#[ \t]*include\b[^\n]*"),
    "zig": Language([("function", rf"\bfn\s+({N})\s*\("), ("class", rf"\bconst\s+({N})\s*(?::[^=;]*)?=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b"), ("enum", rf"\bconst\s+({N})\s*(?::[^=;]*)?=\s*enum\b")], rf"//[^\n]*|\\\\[^\n]*|{_CHAR}", keep=("function", "class", "enum"), imports=r"^(?:pub\s+)?const\s+\w+\s*=\s*@import[^\n]*"),
    "bash": Language([("function", r"^\s*(?:function\s+)?([A-Za-z_][\w:.-]*)\s*\(\s*\)"), ("function", r"^\s*function\s+([A-Za-z_][\w:.-]*)\s*(?=\{)")], r"(?:^|(?<=[\s;]))#[^\n]*|\"(?:\\[\s\S]|[^\"\\])*\"?|'[^']*'?", imports=r"^\s*(?:source|\.)\s[^\n]*"),
    "kotlin": Language([("class", rf"\b(?:class|object)\s+({N})"), ("interface", rf"\binterface\s+({N})"), ("enum", rf"\benum\s+class\s+({N})"), ("function", rf"\bfun\s+(?:<[^<>]*>\s*)?(?:[\w.<>?]+\.)?({N})\s*\(")], rf"{_TRIPLE}|{_C}|{_QUOTED}", owners=("class", "interface", "enum"), member="method", line_ends=True, imports=r"^(?:import|package)\s[^\n]*"),
    "scala": Language([("class", rf"\b(?:class|object)\s+({N})"), ("interface", rf"\btrait\s+({N})"), ("function", rf"\bdef\s+({N}|[^\s\w(\[:]+)"), ("type", rf"^\s*(?:override\s+)?type\s+({N})")], rf"{_TRIPLE}|{_C}|{_CHAR}", owners=("class", "interface"), member="method", line_ends=True, imports=r"^\s*(?:import|package)\s[^\n]*"),
    "groovy": Language([("class", rf"\bclass\s+({N})"), ("interface", rf"\b(?:interface|trait)\s+({N})"), ("enum", rf"\benum\s+({N})"), ("function", rf"(?:^|[{{}};])\s*{_MODS}(?:def|{_NOT}{_TYPED})\s+{_NOT}({N})\s*(?=\()")], rf"{_TRIPLE}|'''[\s\S]*?'''|{_C}|{_QUOTED}", owners=("class", "interface"), member="method", imports=r"^\s*(?:import|package)\s[^\n]*"),
    "php": Language([("class", rf"(?<![\w$:>])(?:class|trait)\s+({N})"), ("interface", rf"\binterface\s+({N})"), ("enum", rf"\benum\s+({N})"), ("function", rf"\bfunction\s+&?\s*({N})\s*\(")], rf"{_C}|#(?!\[)[^\n]*|{_QUOTED}", owners=("class", "interface", "enum"), member="method", imports=r"^\s*(?:use|namespace|require|require_once|include|include_once)\b[^;\n]*;"),
    "csharp": Language([("module", rf"\bnamespace\s+([\w.]+)"), ("class", rf"\b(?:class|struct)\s+({N})"), ("class", rf"\brecord\s+(?:class\s+|struct\s+)?({N})"), ("interface", rf"\binterface\s+({N})"), ("enum", rf"\benum\s+({N})"), ("method", rf"(?:^|[{{}};\]])\s*{_MODS}(?:{_NOT}{_TYPED}\s+)?{_NOT}(~?{N})\s*(?:<[^<>()]*>)?\s*(?=\()")], rf"@\"(?:\"\"|[^\"])*\"|{_TRIPLE}|{_C}|{_QUOTED}|^[ \t]*#[^\n]*", owners=("class", "interface"), keep=("module",), imports=r"^\s*(?:global\s+)?using\s[^;\n]*;"),
    "ruby": Language([("class", r"^[ \t]*class\s+([A-Z][\w:]*)"), ("module", r"^[ \t]*module\s+([A-Z][\w:]*)"), ("function", r"^[ \t]*(?:private\s+|public\s+|protected\s+)?def\s+(?:self\.|[A-Z]\w*\.)?([A-Za-z_]\w*[?!=]?|[+\-*/<>=!\[\]]+)")], rf"^=begin[\s\S]*?^=end|{_HASH}|{_QUOTED}", body="end", owners=("class", "module"), member="method", imports=r"^\s*require(?:_relative)?\b[^\n]*", words=r"^[ \t]*(?:(?:private|public|protected)[ \t]+)?(?P<a>class|module|def|if|unless|while|until|case|begin|for)\b|[=(,][ \t]*(?P<b>if|unless|case|begin|while)\b|\b(?P<c>do)\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|(?P<e>\bend\b)"),
    "lua": Language([("function", r"\bfunction\s+([A-Za-z_][\w.]*(?::[A-Za-z_]\w*)?)\s*\("), ("class", r"^[ \t]*(?:local\s+)?([A-Z]\w*)[ \t]*=[ \t]*\{[ \t]*\}"), ("function", r"^[ \t]*(?:local\s+)?([A-Za-z_][\w.]*)[ \t]*=[ \t]*function\b")], rf"--\[\[[\s\S]*?\]\]|--[^\n]*|\[\[[\s\S]*?\]\]|{_QUOTED}", body="end", keep=("class", "function"), imports=r"^\s*(?:local\s+\w+\s*=\s*)?require\b[^\n]*", words=r"(?P<a>\bfunction\b|\bif\b|\bdo\b|\brepeat\b)|(?P<e>\bend\b|\buntil\b)"),
    "elixir": Language([("module", r"\bdefmodule\s+([A-Z][\w.]*)"), ("interface", r"\bdefprotocol\s+([A-Z][\w.]*)"), ("function", r"^[ \t]*(?:def|defp|defmacro|defmacrop|defguard|defguardp)\s+([a-z_]\w*[?!]?)")], rf"{_TRIPLE}|{_HASH}|{_CHAR}", body="end", owners=("module", "interface"), keep=("module", "interface"), imports=r"^\s*(?:import|alias|require|use)\s[^\n]*", words=r"(?P<a>\bdo\b(?!:)|\bfn\b)|(?P<e>\bend\b)"),
    "julia": Language([("function", r"^[ \t]*function\s+(?:[\w.]+\.)?([A-Za-z_][\w!]*)"), ("function", r"^[ \t]*macro\s+([A-Za-z_][\w!]*)"), ("function", r"^[ \t]*([A-Za-z_][\w!]*)\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)[ \t]*(?:where[^=\n]*)?=(?!=)"), ("class", r"^[ \t]*(?:mutable\s+)?struct\s+([A-Za-z_]\w*)"), ("type", r"^[ \t]*(?:abstract|primitive)\s+type\s+([A-Za-z_]\w*)"), ("module", r"^[ \t]*(?:bare)?module\s+([A-Za-z_]\w*)")], rf"#=[\s\S]*?=#|{_TRIPLE}|{_HASH}|{_CHAR}", body="end", owners=("module",), member="method", keep=("module",), imports=r"^\s*(?:using|import|include)\b[^\n]*", words=r"(?P<a>(?<![\w.:])(?:function|macro|struct|module|baremodule|if|for|while|begin|let|try|quote|do|abstract\s+type|primitive\s+type)\b)|(?P<e>(?<![\w.:])end\b(?!\s*[\])]))"),
    "haskell": Language([("function", r"^([a-z_][\w']*)\b(?=[^\n=:|]*(?:\||=(?!=)))"), ("type", r"^(?:data|newtype|type)\s+(?:instance\s+|family\s+)?([A-Z][\w']*)"), ("class", r"^class\s+(?:[^\n]*=>\s*)?([A-Z][\w']*)"), ("module", r"^module\s+([A-Z][\w.]*)")], r"--[^\n]*|\{-[\s\S]*?-\}|\"(?:\\[\s\S]|[^\"\\])*\"?|(?<![\w'])'(?:\\[^'\n]+|[^'\\\n])'", body="indent", imports=r"^import\s[^\n]*"),
    "ocaml": Language([("function", r"^[ \t]*(?:let|and)\s+(?:rec\s+)?([a-z_][\w']*)(?=\s+(?:[a-z_~?({\[]))"), ("variable", r"^[ \t]*let\s+(?:rec\s+)?([a-z_][\w']*)(?=\s*(?::|=))"), ("type", r"^[ \t]*(?:type|and)\s+(?:nonrec\s+)?(?:\([^)]*\)\s*|[+-]?'\w+\s+)?([a-z_][\w']*)(?=\s*(?:=|:|$))"), ("module", r"^[ \t]*module\s+(?:rec\s+|type\s+)?([A-Z][\w']*)"), ("class", r"^[ \t]*class\s+(?:virtual\s+)?([a-z_][\w']*)")], r"\(\*[\s\S]*?\*\)|\"(?:\\[\s\S]|[^\"\\])*\"?", body="indent", owners=("module", "class"), imports=r"^\s*(?:open|include)\s[^\n]*"),
    "cmake": Language([("function", r"^[ \t]*(?:function|macro)[ \t]*\([ \t\n]*([A-Za-z_][\w-]*)")], rf"#\[\[[\s\S]*?\]\]|{_HASH}|\"(?:\\[\s\S]|[^\"\\])*\"?", body="end", flags=re.MULTILINE | re.IGNORECASE, words=r"(?P<a>\b(?:function|macro)[ \t]*\()|(?P<e>\bend(?:function|macro)[ \t]*\()", imports=r"^[ \t]*include[ \t]*\([^)]*\)"),
    "sql": Language([("class", r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)"), ("class", r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)"), ("function", r"\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.\"`]+)"), ("variable", r"\bcreate\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?(?:\w+\s+on\s+)?([\w.\"`]+)")], r"--[^\n]*|/\*[\s\S]*?\*/|'(?:''|[^'])*'?|\$(\w*)\$[\s\S]*?\$\1\$", body="statement", flags=re.MULTILINE | re.IGNORECASE),
    "css": Language([], rf"/\*[\s\S]*?\*/|{_QUOTED}"),
}
LANGUAGES["javascript"] = Language(_JS_HEADS, LANGUAGES["typescript"].blanks, owners=("class",), keep=("class", "enum"), imports=LANGUAGES["typescript"].imports)
LANGUAGES["c"] = LANGUAGES["cpp"]
for _own, _other in (("tsx", "typescript"), ("jsx", "javascript"), ("c++", "cpp"), ("cs", "csharp"), ("c_sharp", "csharp"), ("shell", "bash"), ("sh", "bash")):
    LANGUAGES[_own] = LANGUAGES[_other]


def _hidden(m: re.Match) -> str:
    """Blanks for all of a match but its line breaks."""
    told = m.group()
    return "\n".join([" " * len(part) for part in told.split("\n")]) if "\n" in told else " " * len(told)


def blanked(content: str, language: Language) -> str:
    """The text with comments and strings as blanks of the same length; line breaks stay."""
    return re.sub(language.blanks, _hidden, content, flags=language.flags)


def pairs_of(code: str, both: str) -> dict[int, int]:
    """Places of opening brackets with those of the ones that close them."""
    out, open_, close = {}, [], both[1]
    for m in re.finditer(f"[{re.escape(both)}]", code):
        if m.group() == close:
            if open_:
                out[open_.pop()] = m.start()
        else:
            open_.append(m.start())
    return out


_STOP = re.compile(r"[({\[;})\]\n]")


def _after_head(code: str, at: int, line_ends: bool, braces: dict[int, int], round_: dict[int, int], square: dict[int, int]) -> tuple[int, bool]:
    """The end of what begins with a head, and whether it has a body in braces."""
    n = len(code)
    while at < n:
        m = _STOP.search(code, at)
        if m is None:
            return n, False
        c, i = m.group(), m.start()
        if c == "{":
            return braces.get(i, n - 1) + 1, True
        if c in "([":
            at = (round_ if c == "(" else square).get(i, n) + 1
        elif c == ";":
            return i + 1, False
        elif c == "\n":
            if line_ends:
                k = i
                while k < n and code[k].isspace():
                    k += 1
                # A body on the next line, or a head that goes on after an operator or a colon.
                if code[k : k + 1] != "{" and code[at:i].rstrip()[-1:] not in ("=", ":", ",", "|", "&", "+"):
                    return i, False
            at = i + 1
        else:  # the end of what encloses the head
            return i, False
    return n, False


def _ends(code: str, language: Language) -> tuple[list[int], dict[int, int]]:
    """Places of the block words that open, ascending, and where the blocks end."""
    out, stack, looped = {}, [], -1
    for m in re.finditer(language.words, code, language.flags):
        if m.lastgroup == "e":
            if stack:
                out[stack.pop()] = m.end()
            continue
        line = code.rfind("\n", 0, m.start(m.lastgroup))
        if m.lastgroup == "c" and line == looped:
            continue  # the ``do`` of a loop that its first word has opened
        looped = line if m.group(m.lastgroup) in ("while", "until", "for") else looped
        stack.append(m.start(m.lastgroup))
    out |= dict.fromkeys(stack, len(code))  # blocks that nothing ends
    return sorted(out), out


def _indented(code: str, at: int, starts: list[int]) -> int:
    """The end of the last line that belongs to what begins at ``at`` by being indented more than its line."""
    line = lambda j: code[starts[j] : starts[j + 1] - 1 if j + 1 < len(starts) else len(code)]
    depth = lambda text: len(text) - len(text.lstrip(" \t"))
    k = bisect.bisect_right(starts, at) - 1
    own, end = depth(line(k)), starts[k] + len(line(k).rstrip())
    for j in range(k + 1, len(starts)):
        text = line(j)
        if text.strip():
            if depth(text) <= own:
                break
            end = starts[j] + len(text.rstrip())
    return end


def _heads(code: str, language: Language) -> list[Declaration]:
    if not language.compiled:
        language.compiled = [(kind, re.compile(p, language.flags)) for kind, p in language.heads]
    braces = pairs_of(code, "{}") if language.body == "brace" else {}
    round_, square = (pairs_of(code, "()"), pairs_of(code, "[]")) if language.body == "brace" else ({}, {})
    opened, ends = _ends(code, language) if language.body == "end" else ([], {})
    starts = [0, *(m.end() for m in re.finditer("\n", code))] if language.body == "indent" else []
    out, n = [], len(code)
    for kind, pattern in language.compiled:
        for m in pattern.finditer(code):
            group = 1 if pattern.groups else 0
            at, name = m.start(group), m.group(group).strip()
            first = code.rfind("\n", 0, at) + 1
            head = m.start() if m.start() >= first else first
            while head < at and (code[head].isspace() or code[head] in "{};,"):
                head += 1
            if language.body == "brace":
                end, body = _after_head(code, m.end() if "=>" in m.group() else m.end(group), language.line_ends, braces, round_, square)
            elif language.body == "end":
                k = bisect.bisect_left(opened, head)
                ended = k < len(opened) and opened[k] <= (m.end() if "\n" not in code[m.end() : opened[k]] else -1)
                line = code.find("\n", m.end())
                line = n if line < 0 else line
                if k < len(opened) and opened[k] < line:
                    ended = True
                end, body = (ends[opened[k]], True) if ended else (line, False)
            elif language.body == "indent":
                end, body = _indented(code, at, starts), True
            else:
                stop = code.find(";", m.end())
                end, body = (n if stop < 0 else stop + 1), True
            out.append((Declaration(head, end, kind, name), body))
    return _judged(code, out, language)


def _judged(code: str, found: list[tuple[Declaration, bool]], language: Language) -> list[Declaration]:
    """Declarations with their owners; heads without a body that need one are dropped."""
    found.sort(key=lambda x: (x[0].start, -x[0].end))
    out, stack, methods = [], [], {id(x[0]) for x in found if x[0].kind == "method"}
    for d, body in found:
        while stack and stack[-1].end <= d.start:
            stack.pop()
        owner = next((o.name for o in reversed(stack) if o.kind in language.owners and o is not d), None)
        inside = next((o for o in reversed(stack) if o.kind in ("class", "interface", "enum", "function", "method", "impl")), None)
        named = d.name in {o.name for o in stack if o.start == d.start}
        if id(d) in methods and language.heads and language is not LANGUAGES["go"]:
            # A method has a body, or is a member of an interface; a call has neither.
            member = inside is not None and inside.kind in ("interface", "class") and not body and _member_like(code, d)
            if (not body or not _signature_like(code, d)) and not member:
                continue
        if named and d.kind in ("method", "function"):
            continue
        if language in (LANGUAGES["cpp"],) and d.kind == "function" and (not body or not _signature_like(code, d)):
            continue
        if language is LANGUAGES["rust"] and d.kind == "function" and not body:
            continue
        d.parent = owner if d.kind not in language.keep else None
        if d.parent is not None and d.kind == "function" and language.member:
            d.kind = language.member
        stack.append(d)
        out.append(d)
    return out


def _signature_like(code: str, d: Declaration) -> bool:
    """Whether only what may stand between parameters and a body does: types, clauses, initialisers."""
    at = code.find("(", d.start, d.end)
    depth, k = 0, at
    while 0 <= k < d.end:
        depth += (code[k] in "([") - (code[k] in ")]")
        k += 1
        if depth == 0:
            break
    brace = code.find("{", k, d.end)
    between = code[k:brace] if brace >= 0 else ""
    return brace >= 0 and ";" not in between and not re.search(r"[=!]=|&&|\|\||\b(?:return|if|for|while)\b", between)


def _member_like(code: str, d: Declaration) -> bool:
    """Whether a head without body is declared where it stands: nothing before it on its line but modifiers and types."""
    before = code[code.rfind("\n", 0, d.start) + 1 : d.start]
    return not before.strip() or before.strip()[-1] in "{;}"


_GO_KIND = re.compile(r"\s*(?:\[[^\]]*\]\s*)?(struct|interface)\b")


def _go(code: str, found: list[Declaration]) -> list[Declaration]:
    for d in found:
        if d.kind == "type":
            m = _GO_KIND.match(code, code.find(d.name, d.start) + len(d.name))
            d.kind = {"struct": "class", "interface": "interface"}[m.group(1)] if m else "type"
        elif d.kind == "method":
            receiver = code[code.find("(", d.start) + 1 : code.find(")", d.start)]
            d.parent = (receiver.split()[-1].lstrip("*").split("[")[0] or None) if receiver.split() else None
    return found


def declarations(content: str, language: str, blocks: bool = False) -> list[Declaration]:
    """The declarations of a file, in order; places are characters. With ``blocks`` also those that only hold others."""
    spec = LANGUAGES[language]
    code = blanked(content, spec)
    found = _heads(code, spec)
    if spec is LANGUAGES["go"]:
        found = _go(code, found)
    elif spec is LANGUAGES["kotlin"]:
        enums = {d.start for d in found if d.kind == "enum"}
        found = [d for d in found if d.kind != "class" or not any(s <= d.start <= s + 5 for s in enums)]
    elif spec is LANGUAGES["lua"]:
        for d in found:
            if ":" in d.name:
                d.parent, d.name = d.name.rsplit(":", 1)
                d.kind = "method"
    elif spec is LANGUAGES["cpp"]:
        found = _aliases(code, found)
    elif spec is LANGUAGES["haskell"]:
        found = _clauses([d for d in found if d.name not in ("data", "type", "newtype", "class", "instance", "module", "import", "infixl", "infixr", "infix", "deriving", "where")])
    elif spec is LANGUAGES["sql"]:
        for d in found:
            d.name = d.name.strip('"`')
    return found if blocks else [d for d in found if d.kind not in ("impl", "namespace")]


def _aliases(code: str, found: list[Declaration]) -> list[Declaration]:
    """``typedef struct {...} Name;`` declares the type that follows its body."""
    out = []
    for d in found:
        if d.kind == "alias":
            m = re.compile(rf"\s*\*?\s*({N})\s*;").match(code, d.end)
            if m:
                out.append(Declaration(d.start, m.end(), "type", m.group(1)))
            continue
        out.append(d)
    return out


def _clauses(found: list[Declaration]) -> list[Declaration]:
    """Neighbouring clauses of one function are one declaration."""
    out: list[Declaration] = []
    for d in found:
        last = out[-1] if out else None
        if last and last.kind == d.kind == "function" and last.name == d.name:
            last.end = d.end
        else:
            out.append(d)
    return out


def imports(content: str, language: str) -> list[tuple[int, int]]:
    """Spans of import statements. They are found where comments are blank; their strings are not."""
    spec = LANGUAGES[language]
    comments = _C if spec.blanks.find("//") >= 0 else r"(?!)"
    code = re.sub(comments, _hidden, content) if comments == _C else content
    return [(m.start() + len(m.group()) - len(m.group().lstrip()), m.start() + len(m.group().rstrip())) for m in re.finditer(spec.imports, code, spec.flags)]


_HOLDS = re.compile(r"[^{};()=]*")


def spans(content: str, language: str, largest: int) -> list[tuple[int, int, str, str]]:
    """(first and last byte, type, name) of what chunks are made of: declarations of at most ``largest`` bytes from their
    modifiers on, of larger ones those inside; imports in a row are one; all else is left out."""
    found = [(a, b, "import_group", "") for a, b in imports(content, language)]
    for d in declarations(content, language, blocks=True):
        line = content.rfind("\n", 0, d.start) + 1
        start = line + len(content[line : d.start]) - len(content[line : d.start].lstrip())
        start = start if _HOLDS.fullmatch(content, start, d.start) else d.start
        plain = not content.startswith("export", start) and (language != "go" or d.kind in ("function", "method"))
        found.append((start, d.end, _TYPES.get(d.kind, "block") if plain else "block", d.name))
    bytes_before = _Bytes(content)
    out: list[tuple[int, int, str, str]] = []
    end = 0
    for start, stop, kind, name in sorted(found, key=lambda x: (x[0], -x[1])):
        a, b = bytes_before(start), bytes_before(stop)
        if a < end or (kind != "import_group" and b - a > largest):
            continue
        end = b
        if kind == "import_group" and out and out[-1][2] == kind:
            out[-1] = (out[-1][0], b, kind, "")
        else:
            out.append((a, b, kind, name))
    return out


#: Types of chunks by the kind of a declaration; others are blocks.
_TYPES = {"function": "function", "method": "function", "class": "class", "interface": "class"}


class _Bytes:
    """Places in UTF-8 of places in a text, asked in ascending order but for steps back inside what was asked last."""

    def __init__(self, content: str):
        self.content, self.plain = content, content.isascii()
        self.marks = [0]
        if not self.plain:
            for k in range(0, len(content), 1024):
                self.marks.append(self.marks[-1] + len(content[k : k + 1024].encode("utf-8", "surrogatepass")))

    def __call__(self, at: int) -> int:
        if self.plain:
            return at
        k = at // 1024
        return self.marks[k] + len(self.content[k * 1024 : at].encode("utf-8", "surrogatepass"))


# Data and markup -----------------------------------------------------------------------------------------------------


def line_of(breaks: list[int], at: int) -> int:
    return bisect.bisect_left(breaks, at) + 1


def yaml_keys(content: str) -> list[Declaration]:
    """The keys of the outermost mapping of each document."""
    out, column, at = [], None, 0
    for line in content.splitlines(keepends=True):
        bare = line.strip()
        if bare.startswith("---"):
            column = None
        elif bare and not bare.startswith("#"):
            indent = len(line) - len(line.lstrip(" "))
            m = re.match(r"\s*(\"[^\"]*\"|'[^']*'|[^\s#'\"\[{&*!|>%@`-][^:#]*?|-?[^\s:#'\"][^:#]*?)\s*:(?:\s|$)", line)
            if m and not bare.startswith("- ") and (column is None or indent == column):
                column = indent
                out.append(Declaration(at + m.start(1), at + len(line.rstrip()), "variable", m.group(1)))
            elif out and column is not None and (indent > column or bare.startswith("- ")):
                out[-1].end = at + len(line.rstrip())
        at += len(line)
    return out


def toml_tables(content: str) -> list[Declaration]:
    """Tables with bare names; a table goes on to the next."""
    code = re.sub(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", _hidden, content)
    found = [(m.start(), m.group(1)) for m in re.finditer(r"^[ \t]*\[\[?[ \t]*([^\]\n]+?)[ \t]*\]\]?[ \t]*(?:#.*)?$", code, re.MULTILINE)]
    ends = [b for (_, _), (b, _) in pairwise(found)] + [len(content)]
    return [Declaration(a, a + len(content[a:b].rstrip()), "module", name) for (a, name), b in zip(found, ends, strict=True) if re.fullmatch(r"[A-Za-z0-9_-]+", name)]


def json_keys(content: str) -> list[Declaration]:
    """The keys of the outermost object, read to where the text stops being JSON."""
    decode, space = json.JSONDecoder(), re.compile(r"\s*")
    at, out = space.match(content).end(), []
    if content[at : at + 1] != "{":
        return out
    at += 1
    try:
        while True:
            at = space.match(content, at).end()
            if content[at : at + 1] != '"':
                return out
            name, after = decode.raw_decode(content, at)
            colon = space.match(content, after).end()
            if content[colon : colon + 1] != ":":
                return out
            _, end = decode.raw_decode(content, space.match(content, colon + 1).end())
            if name:
                out.append(Declaration(at, end, "variable", name))
            at = space.match(content, end).end()
            if content[at : at + 1] != ",":
                return out
            at += 1
    except (ValueError, RecursionError):
        return out


_TAG = re.compile(r"<!--[\s\S]*?-->|<(script|style)\b[^>]*>[\s\S]*?</\1\s*>|<(/?)([A-Za-z][\w:-]*)((?:\s+[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*)\s*(/?)>", re.IGNORECASE)
_ID = re.compile(r"(?<![\w-])id\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: Elements without content. (fixed values)
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))


def html_symbols(content: str) -> list[Declaration]:
    """``#id`` of elements with a quoted id, and headings by their own text, at most 60 characters."""
    out: list[Declaration] = []
    open_: list[tuple[str, list[Declaration], int]] = []
    texts: list[list[str]] = []
    at = 0
    for m in _TAG.finditer(content):
        if texts:
            texts[-1].append(content[at : m.start()])
        at = m.end()
        if m.group(3) is None:
            continue
        tag, closing, attributes, empty = m.group(3).lower(), m.group(2), m.group(4) or "", m.group(5)
        if not closing:
            own = [Declaration(m.start(), m.end(), "variable", f"#{(i.group(1) or i.group(2)).strip()}") for i in _ID.finditer(attributes) if (i.group(1) or i.group(2) or "").strip()]
            if re.fullmatch(r"h[1-6]", tag):
                own.append(Declaration(m.start(), m.end(), "module", ""))
            out += own
            if not empty and tag not in _VOID:
                open_.append((tag, own, m.start()))
                texts.append([])
            continue
        if any(t == tag for t, _, _ in open_):
            while open_:
                name, own, _ = open_.pop()
                parts = [" ".join(p.split()) for p in texts.pop()]
                for d in own:
                    d.end = m.end() if name == tag else m.start()
                    if d.kind == "module":
                        d.name = " ".join(p for p in parts if p)[:60]
                if name == tag:
                    break
    return [d for d in out if d.name]


def css_symbols(content: str) -> list[Declaration]:
    """Rules by their first selector, media rules, key frames and imports of the outermost level."""
    code, out, at = blanked(content, LANGUAGES["css"]), [], 0
    braces = pairs_of(code, "{}")
    while True:
        m = re.compile(r"[{;]").search(code, at)
        if m is None:
            return out
        start = at + len(code[at : m.start()]) - len(code[at : m.start()].lstrip())
        shown = content[start : m.start()].strip()
        end = braces.get(m.start(), len(code) - 1) + 1 if m.group() == "{" else m.end()
        low = shown.lower()
        if low.startswith("@import"):
            out.append(Declaration(start, end, "variable", content[start:end].strip()[:60]))
        elif m.group() == "{" and low.startswith("@media"):
            out.append(Declaration(start, end, "module", "@media"))
        elif m.group() == "{" and re.match(r"@(?:-\w+-)?keyframes\b", low):
            out.append(Declaration(start, end, "function", f"@keyframes {shown.split(None, 1)[1].strip() if ' ' in shown else ''}".strip()))
        elif m.group() == "{" and shown and not shown.startswith("@"):
            first = shown.split(",")[0].strip()
            if len(first) <= 80:
                out.append(Declaration(start, end, "class", first))
        at = end


def markdown_headings(content: str) -> list[Declaration]:
    """Headings outside of fenced code: those of an outermost section are modules, those below functions."""
    out, fence, at, open_, before = [], None, 0, [], None
    for line in content.splitlines(keepends=True):
        bare = line.strip()
        mark = re.match(r"(```+|~~~+)", bare)
        if mark and (fence is None or bare.startswith(fence)):
            fence = None if fence else mark.group(1)
        elif fence is None:
            m = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
            under = re.match(r"\s{0,3}(=+|-+)\s*$", line) if before and before[1].strip() and not re.match(r"\s*(?:[#>*+-]|\d+\.)", before[1]) else None
            if m or under:
                level, name, start = (len(m.group(1)), m.group(2), at) if m else (1 if under.group(1)[0] == "=" else 2, before[1].strip(), before[0])
                while open_ and open_[-1] >= level:
                    open_.pop()
                if name:
                    out.append(Declaration(start, at + len(line.rstrip()), "module" if not open_ else "function", name))
                open_.append(level)
                before = None
                at += len(line)
                continue
        before = (at, line) if fence is None and bare else None
        at += len(line)
    return out


def svelte_symbols(content: str) -> list[Declaration]:
    """Exports and functions of scripts, and a mark for styles."""
    out = []
    for m in re.finditer(r"<script\b[^>]*>([\s\S]*?)</script\s*>", content, re.IGNORECASE):
        code, offset = blanked(m.group(1), LANGUAGES["typescript"]), m.start(1)
        exported = [(e.start(), e.end(), e.group(1)) for e in re.finditer(rf"\bexport\s+(?:let|const|(?:async\s+)?function)\s+({N})", code)]
        out += [Declaration(offset + a, offset + b, "variable", name) for a, b, name in exported]
        inside = {b for _, b, _ in exported}
        out += [Declaration(offset + f.start(), offset + f.end(1), "function", f.group(1)) for f in re.finditer(rf"\bfunction\s+({N})\s*\(", code) if f.end(1) not in inside]
    out += [Declaration(m.start(), m.end(), "module", "<style>") for m in re.finditer(r"<style\b[^>]*>[\s\S]*?</style\s*>", content, re.IGNORECASE)]
    return sorted(out, key=lambda d: d.start)


MARKUP = {"yaml": yaml_keys, "yml": yaml_keys, "toml": toml_tables, "json": json_keys, "html": html_symbols, "css": css_symbols, "markdown": markdown_headings, "md": markdown_headings, "svelte": svelte_symbols}


def known(language: str) -> bool:
    return language in MARKUP or language in LANGUAGES


def scanned(content: str, language: str) -> list[Declaration]:
    """Declarations by the scanner of a language."""
    return MARKUP[language](content) if language in MARKUP else declarations(content, language)
