"""Reading one function row: its signature, code and documentation, and whether the documentation says something."""

from __future__ import annotations

import re
from typing import NamedTuple

# Texts that stand where documentation should be, and the words a restated name is wrapped in.
PLACEHOLDER = re.compile(
    r"""(?ix)^\W*(?:
    todo|fixme|tbd|tba|xxx|n/?a|none|null|nil|wip|\.{2,}|…|-+|=+|\*+|undocumented|not\ documented|no\ (?:docs?|documentation|description|comment)\b.*|placeholder|stub|auto-?generated(?:\ (?:method|function)?\ ?stub)?
    |(?:todo|fixme|tbd|xxx)\b.*|(?:write|add|fill\ in)\ (?:the\ )?(?:docs?|documentation|description)\b.*|docs?\ (?:later|to\ follow|pending|missing)|documentation\ (?:pending|to\ follow|missing)|description\ (?:here|goes\ here|missing)|coming\ soon
    |does\ what\ the\ name\ says|self[- ]explanatory|as\ the\ name\ (?:says|suggests)|obvious
    |sin\ documentar|por\ documentar|pendiente(?:\ de\ documentar)?|sin\ descripci[oó]n|[àa]\ compl[ée]ter|non\ document[ée]e?|[àa]\ documenter|documentation\ [àa]\ venir
    |dokumentation\ folgt|nicht\ dokumentiert|undokumentiert|noch\ (?:zu\ )?dokumentieren|beschreibung\ folgt
    |待补充|待完善|待办|暂无(?:说明|文档|描述)?|无(?:说明|文档)?|未完成|稍后补充|文档待补
    |old\ version(?:\ below)?|legacy\ version|disabled|commented\ out|deprecated|removed
    )\W*$"""
)
ELSEWHERE = re.compile(
    r"(?ix)^\W*(?:\{?@?inherit[-_ ]?docs?\}?|@(?:copydoc|copybrief|see|override|overrides)\b.*|see\s+(?:also\s+)?(?:the\s+)?[\w.:#`{}@()/-]+(?:\s+(?:class|method|function|docs?|documentation|header|above|below|for\s+details))?"
    r"|siehe\s+\S+(?:\s+\S+)?|ver\s+\S+(?:\s+\S+)?|voir\s+\S+(?:\s+\S+)?|参见\S*|见\S{0,6}|inherited(?:\s+from\s+\S+)?|same\s+as\s+\S+|overrides?\s+\S+)\W*$"
)
NOTICE = re.compile(r"(?i)^\W*(?:\(c\)|©|copyright\b|licen[sc]ed?\b|spdx-|all rights reserved|author\s*:|@(?:author|license|copyright|since|version|date)\b|part of the .{1,60} project|this file belongs|permission to use)")
TAG = re.compile(r"(?:^|\s)(?:[@\\](?:param|params|arg|args|return|returns|retval|throws?|exception|raises?|type|rtype|tparam|see|since|author|deprecated|todo|override|private|public|internal|brief|version|example)\b|:(?:param|parameter|arg|argument|type|return|returns|rtype|raises?|raise)\b[^:\n]*:)")
PARAM_LINE = re.compile(r"^\s*(?:[-*•]\s*)?(?:`{1,2}[\w.$&*]+`{1,2}|[A-Za-z_$][\w$]*)\s*(?:\([^)]*\))?\s*(?::|--|–|—)\s*\S.{0,80}$")
HEADING = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|notes?|parámetros|paramètres|parameter|参数|返回)\s*:?\s*$", re.I)
CODE_LINE = re.compile(
    r"^\s*(?:[\w.$\[\]]+\s*(?:[-+*/|&^]?=|:=)\s*\S.*|(?:return|print|emit_signal|yield|throw|raise|await|del|delete)\b[\s(].*|(?:if|for|while|switch|match|elif|else|try|func|fn|def|function|var|let|const|class)\b.*[:{(;]\s*$"
    r"|[\w.$>:-]+\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*[;{]?|[{}();\[\]]+|(?:return|break|continue|pass|else)\s*;?|\#(?:include|define|if|endif|else)\b.*|.*;\s*|.*\{\s*)$"
)
FILLER = set(
    """a an the this that these those it its is are be was will would shall can may do does done method methods function functions func fn def procedure routine which what called call calls
    in order to of for on by with from and or as at into returns return returned returning result results value values gets get sets set handles handle handler implementation implements perform performs performing
    performed operation used use uses helper given param params parameter parameters argument arguments self new class object name named simply just here there main entry point
    le la les un une des du de el los las una der die das ein eine den dem il et y und ist es se que qui pour por para fonction méthode función método funktion methode retourne renvoie devuelve gibt zurück""".split()
)
WORDS = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+")
HAN = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*$", re.M)
COMMENT = re.compile(r"^\s*(?:///?!?|//!|##?!?|--|\*|/\*\*?!?|;|%)")
DOCSTRING = re.compile(r'^\s*[rRuUbB]{0,2}("""|\'\'\')')
SIGNATURE = re.compile(r"[\w$~>\]]\s*(?:<[^<>()]*>)?\s*\(")


class Function(NamedTuple):
    signature: str
    overload: str
    code: str
    has_body: bool
    documentation: str
    says_something: bool
    further: str


def split_fence(content: str) -> tuple[str, str]:
    """Code inside the first fence and the prose outside of it; without a fence all is code."""
    marks = list(FENCE.finditer(content))
    if not marks:
        return content, ""
    first = marks[0]
    last = marks[1] if len(marks) > 1 else None
    code = content[first.end() : last.start() if last else len(content)].strip("\n")
    return code, (content[: first.start()] + "\n" + (content[last.end() :] if last else "")).strip()


def uncomment(lines: list[str]) -> str:
    """Text of comment lines without their marks."""
    out = []
    for line in lines:
        line = re.sub(r"^\s*(?:/\*\*?!?|///?!?|//!|\*/|\*(?!\*)|##?!?|--+(?=\s|$)|;+|%+)\s?", "", line)
        out.append(re.sub(r"\s*\*+/\s*$", "", line))
    return "\n".join(out).strip()


def read_code(code: str) -> tuple[str, str, str, bool]:
    """Signature, code without documentation, own documentation comment and whether there is a body."""
    lines = code.replace("\r\n", "\n").split("\n")
    at, before, inside = 0, [], False
    while at < len(lines):
        line = lines[at]
        if inside:
            before.append(line)
            inside = "*/" not in line
        elif not line.strip() or line.lstrip().startswith(("@", "#[", "[")) and not SIGNATURE.search(line.split("]", 1)[-1]):
            before.append("")
        elif re.match(r"\s*/\*", line):
            before.append(line)
            inside = "*/" not in line
        elif COMMENT.match(line) and not re.match(r"\s*#(?:include|define|version|if)", line):
            before.append(line)
        elif m := DOCSTRING.match(line):
            quote = m[1]
            text = [line]
            while text[-1].count(quote) < (2 if len(text) == 1 else 1) and at + 1 < len(lines):
                at += 1
                text.append(lines[at])
            before.append("\n".join(text).replace(quote, ""))
        else:
            break
        at += 1
    if at >= len(lines):
        return "", code, uncomment(before), False
    end = at
    depth = 0
    while end < len(lines):
        depth += lines[end].count("(") - lines[end].count(")")
        if depth <= 0:
            break
        end += 1
    signature = " ".join(line.strip() for line in lines[at : end + 1])
    rest = lines[end + 1 :]
    doc = uncomment(before)
    k = 0
    while k < len(rest) and not rest[k].strip():
        k += 1
    if k < len(rest) and (m := DOCSTRING.match(rest[k])):
        quote, text = m[1], []
        opened = rest[k]
        text.append(opened)
        while (opened.count(quote) < 2 if len(text) == 1 else quote not in text[-1]) and k + 1 < len(rest):
            k += 1
            text.append(rest[k])
        doc = f"{doc}\n" + re.sub(r"^\s*[rRuUbB]{0,2}", "", "\n".join(text)).replace(quote, "")
        rest = rest[k + 1 :]
    body = any(line.strip() and line.strip() not in ("}", "};", "end") for line in rest) or bool(re.search(r"\{.*\S.*\}", signature))
    return re.sub(r"\s*[{:]\s*$", "", signature), "\n".join([*lines[at : end + 1], *rest]), doc.strip(), body


def overload_of(signature: str) -> str:
    """Parameter types in order, without names, defaults, qualifiers or white space."""
    start = signature.find("(")
    go = re.match(r"\s*func\s*\([^)]*\)\s*\w+\s*\(", signature)
    if go:
        start = go.end() - 1
    if start < 0:
        return ""
    depth, parts, current = 0, [], ""
    for c in signature[start + 1 :]:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
            if depth < 0:
                break
        if c == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += c
    parts.append(current)
    types = []
    for part in parts:
        part = re.sub(r"=.*$", "", part).strip()
        if not part or part in ("self", "&self", "&mut self", "cls", "void", "this"):
            continue
        if ":" in part.replace("::", ""):
            kind = part.split(":", 1)[1]
        elif go or re.match(r"^\w+ [\[\]*.\w]+$", part) and signature.lstrip().startswith("func "):
            kind = part.split(None, 1)[-1]
        else:
            kind = re.sub(r"\s*\b\w+\s*$", "", part) or "?"
        types.append(re.sub(r"\b(?:const|mut|final|in|out|inout)\b|\s", "", kind))
    return ",".join(types)


def pieces(text: str) -> set[str]:
    """Lower-case parts of the identifiers and words in a text."""
    return {part.lower() for word in re.findall(r"[^\W\d]\w*", text) for part in CAMEL.split(word) if part}


def plain_doc(text: str, signature: str) -> str:
    """Documentation without tags, parameter lists, placeholders, references elsewhere, notices, disabled code and the signature."""
    kept = []
    bare = re.sub(r"\W", "", signature)
    below = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        tag = TAG.search(line)
        if tag:
            line = line[: tag.start()]
        line = line.strip().strip("*").strip()
        if not line or HEADING.match(line):
            continue
        squeezed = re.sub(r"\W", "", line)
        if squeezed and bare and (squeezed == bare or len(squeezed) > 8 and squeezed in bare):
            continue
        if below or re.match(r"(?i)\W*(?:(?:old|legacy|previous) version\b|disabled\b|commented out\b)", line):
            below = True
            continue
        if PLACEHOLDER.match(line) or ELSEWHERE.match(line) or NOTICE.match(line) or CODE_LINE.match(line) or PARAM_LINE.match(line):
            continue
        kept.append(line)
    return "\n".join(kept)


def informative(text: str, name: str, signature: str) -> bool:
    """Whether a documentation text says something beyond the function's name and signature."""
    plain = plain_doc(text, signature)
    if not plain:
        return False
    known = pieces(name) | pieces(signature)
    known |= {w + "s" for w in known} | {w[:-1] for w in known if w.endswith("s")} | {w + "es" for w in known} | {w + "ing" for w in known} | {w[:-1] + "ing" for w in known if w.endswith("e")} | {w + "ed" for w in known} | {w + "d" for w in known}
    if len(HAN.findall(plain)) >= 5:
        return True
    fresh = {w for word in WORDS.findall(plain) for w in (part.lower() for part in CAMEL.split(word)) if w and w not in known and w not in FILLER and len(w) > 1}
    return len(fresh) >= 3


def read_function(name: str | None, content: str | None, summary: str | None) -> Function:
    code, prose = split_fence(content or "")
    signature, bare, comment, body = read_code(code)
    own = "\n".join(t for t in (comment, prose) if t)
    texts = [t for t in (own, summary or "") if t.strip()]
    useful = [t for t in texts if informative(t, name or "", signature)]
    documentation, further = [*(plain_doc(t, signature) for t in useful), "", ""][:2]
    return Function(signature, overload_of(signature), bare, body, documentation, bool(useful), further)


def beyond_counterpart(name: str | None, signature: str, counterpart: str, *documentations: str) -> list[str]:
    """Of a function's documentations those that also say something beyond its ``counterpart``'s signature (a definition's declaration, or the other way round)."""
    plain = [plain_doc(text, counterpart) for text in documentations]
    return [text for text in plain if informative(text, name or "", f"{signature} {counterpart}")]
