"""Call sites of module texts, with what each names: a procedure of its own module, of a common module, of a manager.

A name before a dot is a module only if no assignment that reaches the call makes it a value. Assignments are followed
through the blocks of a procedure: the last one on the call's own path, and those after it in branches that have ended.
Two rounds over a project: ``factories_of`` finds exported functions that return values which they build, and
``call_sites_of`` takes them as known.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.source_code import NOT_CALLS, masked, outline, without_deleted

# Collections of managers in both languages and the kinds of their objects.
MANAGERS = {
    "справочники": "Справочник", "catalogs": "Справочник", "документы": "Документ", "documents": "Документ", "регистрысведений": "РегистрСведений", "informationregisters": "РегистрСведений",
    "регистрынакопления": "РегистрНакопления", "accumulationregisters": "РегистрНакопления", "регистрыбухгалтерии": "РегистрБухгалтерии", "accountingregisters": "РегистрБухгалтерии",
    "отчеты": "Отчет", "reports": "Отчет", "обработки": "Обработка", "dataprocessors": "Обработка", "перечисления": "Перечисление", "enums": "Перечисление", "регистрырасчета": "РегистрРасчета",
    "calculationregisters": "РегистрРасчета", "планывидовхарактеристик": "ПланВидовХарактеристик", "chartsofcharacteristictypes": "ПланВидовХарактеристик", "планысчетов": "ПланСчетов",
    "chartsofaccounts": "ПланСчетов", "планыобмена": "ПланОбмена", "exchangeplans": "ПланОбмена", "бизнеспроцессы": "БизнесПроцесс", "businessprocesses": "БизнесПроцесс", "задачи": "Задача", "tasks": "Задача",
    "константы": "Константа", "constants": "Константа",
}
SINGLE = {
    "catalog": "Справочник", "document": "Документ", "informationregister": "РегистрСведений", "accumulationregister": "РегистрНакопления", "accountingregister": "РегистрБухгалтерии", "report": "Отчет",
    "dataprocessor": "Обработка", "enum": "Перечисление", "calculationregister": "РегистрРасчета", "chartofcharacteristictypes": "ПланВидовХарактеристик", "chartofaccounts": "ПланСчетов",
    "exchangeplan": "ПланОбмена", "businessprocess": "БизнесПроцесс", "task": "Задача",
} | {v.lower(): v for v in MANAGERS.values()}
# Methods that managers have by themselves, kinds whose missing objects are told, names of loaders and of the call that goes on.
MANAGER_METHODS = frozenset(
    """
    найтипонаименованию findbydescription найтипокоду findbycode найтипореквизиту findbyattribute создатьэлемент createitem создатьгруппу createfolder создатьдокумент createdocument выбрать select
    выбратьиерархически selecthierarchically найтипономеру findbynumber создатьбизнеспроцесс createbusinessprocess создатьзадачу createtask создатьсчет createaccount создатьузел createnode этотузел thisnode
    пустаяссылка emptyref получитьмакет gettemplate получитьформу getform получитьполноеимя getfullname получитьссылку getref создатьменеджерзаписи createrecordmanager создатьнаборзаписей createrecordset
    срезпоследних slicelast срезпервых slicefirst
    """.split()
)
LISTED = ("справочник", "документ", "константа")
LOADERS = ("общиймодуль", "commonmodule", "вычислить", "eval")
MANAGER_LOADERS = ("менеджеробъектапополномуимени", "objectmanagerbyfullname")
PROCEED = ("продолжитьвызов", "proceedwithcall")
UNDEFINED = ("неопределено", "undefined")
OPEN = frozenset("если if для for пока while попытка try".split())
NEXT = frozenset("иначеесли elsif иначе else исключение except".split())
CLOSE = frozenset("конецесли endif конеццикла enddo конецпопытки endtry".split())
LOOP = ("для", "for", "каждого", "each")
RETURN = ("возврат", "return")
NEW = ("новый", "new")

CONTEXT = 120
#: Names that every executor may hold.
MAX_NAMES = 2_000_000

_W = r"[^\W\d]\w*"
_CHAIN = re.compile(rf"(?<![\w.]){_W}(?:\s*\.\s*{_W})*\s*\(")
_ASSIGN = re.compile(rf"^\s*({_W})\s*=\s*(.*)$", re.S)
_LOADED = re.compile(rf'^(?:{_W}\s*\.\s*)?({_W})\s*\(\s*"\s*({_W}(?:\.{_W})?)\s*"\s*\)$', re.S)
_BLOCK = re.compile(r"(?<![\w.])(" + "|".join(sorted(OPEN | NEXT | CLOSE)) + r")(?!\w)", re.I)
_LOOP = re.compile(rf"(?:для|for)\s+(?:(?:каждого|each)\s+)?({_W})", re.I)
_VALUE = "value"


class CallSite(NamedTuple):
    caller: str
    line: int
    kind: str
    callee_module: str
    callee: str
    context: str


@dataclass
class Known:
    """What a project has: modules (short names of common modules), objects by kind, factories by module; all in lower case.

    ``platform``: functions and objects of the platform, ``methods``: methods of its values. A variable that a factory's
    result is assigned to is a value, as is one of any call but a loader's.
    """

    modules: frozenset[str] = frozenset()
    objects: dict[str, frozenset[str]] = field(default_factory=dict)
    factories: dict[str, frozenset[str]] = field(default_factory=dict)
    platform: frozenset[str] = frozenset()
    methods: frozenset[str] = frozenset()


class _Statement(NamedTuple):
    line: int
    plain: str
    text: str
    path: tuple[int, ...]
    ended: bool


def _statements(plain: str, text: str, first_line: int) -> Iterator[_Statement]:
    """The statements of a body with the blocks they stand in. ``plain`` has strings and comments blanked."""
    stack: list[int] = []
    count, at = 0, 0
    for end in [m.start() for m in re.finditer(r"[;\n]", plain)] + [len(plain)]:
        part = plain[at:end]
        closing = 0
        for m in _BLOCK.finditer(part):
            word = m[1].lower()
            if word in CLOSE:
                closing += 1
                continue
            if word in NEXT and stack:
                stack.pop()
            count += 1
            stack.append(count)
        if part.strip():
            yield _Statement(first_line + plain.count("\n", 0, at), part, text[at:end], tuple(stack), plain[end : end + 1] == ";")
        del stack[len(stack) - min(closing, len(stack)) :]
        at = end + 1


def _manager(kind: str, name: str, kinds: dict[str, str], known: Known) -> str | None:
    """The dotted name of an object's manager, if the kind has managers and the object may be there."""
    single = kinds.get(kind.lower())
    listed = known.objects.get((single or "").lower())
    return f"{single}.{name}" if single and (not listed or name.lower() in listed) else None


def _meaning(value: str, text: str, known: Known) -> str | None:
    """What an assigned expression is: ``module:X``, ``manager:Kind.X``, a value, or null for undefined."""
    bare, spelt = value.strip(), text.strip()
    if bare.lower() in UNDEFINED or not bare:
        return None
    if re.fullmatch(_W, bare):
        return f"module:{bare}" if bare.lower() in known.modules else _VALUE
    if m := re.fullmatch(rf"({_W})\s*\.\s*({_W})", bare):
        found = _manager(m[1], m[2], MANAGERS, known)
        return f"manager:{found}" if found else _VALUE
    if m := _LOADED.match(spelt):
        loader, named = m[1].lower(), m[2]
        if loader in MANAGER_LOADERS and "." in named:
            found = _manager(*named.split(".", 1), SINGLE, known)
            return f"manager:{found}" if found else _VALUE
        if loader in LOADERS:
            if "." in named:
                found = _manager(*named.split(".", 1), MANAGERS, known)
                return f"manager:{found}" if found else _VALUE
            return f"module:{named}" if loader in LOADERS[:2] or named.lower() in known.modules else _VALUE
    return _VALUE


def _reaching(events: list[tuple[float, tuple[int, ...], str]], at: int, path: tuple[int, ...]) -> set[str]:
    """The meanings that may reach place ``at`` on ``path``: the last on the path, and later ones in branches that ended."""
    before = [e for e in events if e[0] < at]
    on_path = [e for e in before if path[: len(e[1])] == e[1]]
    found = {on_path[-1][2]} if on_path else set()
    since = on_path[-1][0] if on_path else -1
    return found | {m for place, p, m in before if place > since and path[: len(p)] != p}


class _Body(NamedTuple):
    name: str
    is_function: bool
    is_export: bool
    intercepts: str
    directive: str
    start: int
    statements: list[_Statement]
    events: dict[str, list[tuple[float, tuple[int, ...], str]]]


def _bodies(text: str, known: Known, attributes: frozenset[str]) -> list[_Body]:
    text = without_deleted(text.replace("\r\n", "\n"))
    plain, out = masked(text), []
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    for p in outline(text):
        a, b = starts[p.start_line - 1], min(starts[min(p.end_line, len(starts) - 1)], len(text))
        head = re.compile(r"\)[^\n;]*").search(plain, plain.find("(", a), b)
        body = head.end() if head else a
        statements = list(_statements(plain[body:b], text[body:b], p.start_line + plain.count("\n", a, body)))
        events: dict[str, list] = defaultdict(list)
        for name in re.findall(rf"(?:^|,)\s*(?:(?:val|знач)\s+)?({_W})", p.params, re.I):
            events[name.lower()].append((-1, (), _VALUE))
        for name in attributes:
            events[name].append((-2, (), _VALUE))
        for i, s in enumerate(statements):
            for m in _LOOP.finditer(s.plain):
                events[m[1].lower()].append((i - 0.5, s.path, _VALUE))
            tail = re.split(r"\b(?:then|тогда|do|цикл|else|иначе|try|попытка|except|исключение)\b", s.plain, flags=re.I)[-1]
            if m := _ASSIGN.match(tail):
                value = m[2]
                whole = s.text[len(s.text) - len(value) :] if value else ""
                meaning = _meaning(value, whole, known)
                if meaning:
                    # A reference that goes on in the next line is the start of a chain.
                    events[m[1].lower()].append((i, s.path, meaning if s.ended else _VALUE))
        out.append(_Body(p.name, p.kind == "function", p.is_export, p.intercepts, p.directive, p.start_line, statements, events))
    return out


def factories(text: str, known: Known | None = None) -> list[str]:
    """Exported functions, in lower case, that return what they have built: a new value, a manager's, or a variable of one."""
    known, out = known or Known(), []
    for b in _bodies(text, known, frozenset()):
        if not (b.is_function and b.is_export):
            continue
        for i, s in enumerate(b.statements):
            words = s.plain.split(None, 1)
            if len(words) == 2 and words[0].lower() in RETURN:
                value = words[1].strip()
                chain = re.match(rf"({_W})\s*\.\s*{_W}\s*\.\s*{_W}\s*\(", value)
                built = value.split(None, 1)[0].lower() in NEW or (chain is not None and chain[1].lower() in MANAGERS)
                if built or re.fullmatch(_W, value) and _reaching(b.events[value.lower()], i, s.path) == {_VALUE} and any(p >= 0 for p, _, _ in b.events[value.lower()]):
                    out.append(b.name.lower())
                    break
    return out


def call_sites(text: str, known: Known | None = None, attributes: frozenset[str] = frozenset()) -> list[CallSite]:
    """The calls of a module in order: kind local, common_module, manager, manager_object or override.

    Left out are calls of the platform (unless the module has a procedure of that name), of a procedure by itself, of
    methods of values, and a second call of a name on a line. A call through a variable that may hold different modules,
    or a module and a value, is left out as well. An interceptor begins with an override call of what it intercepts;
    the call that goes on inside it is one, too.
    """
    known, out = known or Known(), []
    bodies, lines = _bodies(text, known, attributes), text.replace("\r\n", "\n").split("\n")
    own = {b.name.lower() for b in bodies}
    for b in bodies:
        if b.intercepts:
            out.append(CallSite(b.name, b.start, "override", "", b.intercepts, b.directive))
        seen: set[tuple[int, str]] = set()
        for i, s in enumerate(b.statements):
            for m in _CHAIN.finditer(s.plain):
                line = s.line + s.plain.count("\n", 0, m.start())
                words = re.sub(r"[\s(]", "", m[0]).split(".")
                if re.search(rf"(?:^|\W)(?:{'|'.join(NEW)})\s+$", s.plain[: m.start()], re.I):
                    continue
                found = _named(words, b, i, s, known, own)
                if found and (line, found[2].lower()) not in seen:
                    seen.add((line, found[2].lower()))
                    out.append(CallSite(b.name, line, *found, lines[line - 1].strip()[:CONTEXT]))
    return out


def _named(words: list[str], b: _Body, i: int, s: _Statement, known: Known, own: set[str]) -> tuple[str, str, str] | None:
    low, callee = [w.lower() for w in words], words[-1]
    if len(words) == 1:
        if low[0] in PROCEED and b.intercepts:
            return "override", "", b.intercepts
        if low[0] in NOT_CALLS or low[0] == b.name.lower() or len(low[0]) < 2 or low[0] in known.platform and low[0] not in own:
            return None
        return "local", "", callee
    reach = _reaching(b.events[low[0]], i, s.path) if low[0] in b.events else set()
    if len(words) == 3 and low[0] in MANAGERS and not reach:
        single = MANAGERS[low[0]]
        listed = known.objects.get(single.lower(), frozenset())
        platform, there = low[2] in MANAGER_METHODS, low[1] in listed
        if single.lower() in LISTED and (platform or not there):
            kind = "manager_object"
        elif platform or listed and not there:
            return None
        else:
            kind = "manager"
        return kind, f"{single}.{words[1]}.МодульМенеджера", callee
    if len(words) != 2:
        return None
    module = words[0]
    aliases = {m for m in reach if m != _VALUE}
    if aliases:
        if len(reach) > 1:
            return None
        kind, _, module = aliases.pop().partition(":")
        if kind == "manager":
            return None if low[1] in MANAGER_METHODS else ("manager", f"{module}.МодульМенеджера", callee)
    elif reach:
        return None
    name = module.lower()
    if name not in known.modules and (name in MANAGERS or name in known.platform or len(name) < 3 or module[0].islower()):
        return None
    if low[1] in known.methods:
        return None
    return "common_module", module, callee


# -- over tables ----------------------------------------------------------------------------------------------------------


def factories_of(modules: DataFrame, known: Known | None = None) -> DataFrame:
    """module, factory of (module, text): the first round."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, f) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in factories(t or "", known)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["module", "factory"])

    return modules.select("module", "text").mapInArrow(found, "module string, factory string")


def known_names(modules: DataFrame, objects: DataFrame, factory_rows: DataFrame | None = None, platform: list[str] | None = None, methods: list[str] | None = None) -> Known:
    """What a project has, collected: at most MAX_NAMES names, more are an error.

    ``modules``: module (short names of common modules); ``objects``: kind, name; ``factory_rows``: of ``factories_of``.
    """
    def names(frame: DataFrame) -> list:
        rows = frame.distinct().limit(MAX_NAMES + 1).collect()
        if len(rows) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names")
        return rows

    by_kind: dict[str, set[str]] = defaultdict(set)
    for r in names(objects.select(F.lower("kind").alias("kind"), F.lower("name").alias("name"))):
        by_kind[r.kind].add(r.name)
    made: dict[str, set[str]] = defaultdict(set)
    for r in names(factory_rows.select(F.lower("module").alias("module"), "factory")) if factory_rows is not None else []:
        made[r.module].add(r.factory)
    frozen = lambda d: {k: frozenset(v) for k, v in d.items()}
    return Known(frozenset(r.module for r in names(modules.select(F.lower("module").alias("module")))), frozen(by_kind), frozen(made), frozenset(platform or ()), frozenset(methods or ()))


def call_sites_of(modules: DataFrame, known: Known) -> DataFrame:
    """source_id, module, place (a call's number in its module) and the fields of CallSite of (source_id, module, text,
    attributes: array of names): the second round.

    An override call names its own module, as it is looked up in the other sources.
    """
    shared = modules.sparkSession.sparkContext.broadcast(known)  # at most MAX_NAMES names

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, module, text, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place, c in enumerate(call_sites(text or "", shared.value, frozenset(x.lower() for x in names or ()))):
                    rows.append((source, module, place, *c._replace(callee_module=module if c.kind == "override" else c.callee_module)))
            yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=schema)

    columns, numbers = ["source_id", "module", "place", *CallSite._fields], ("place", "line")
    schema = pa.schema([(c, pa.int32() if c in numbers else pa.string()) for c in columns])
    rows = modules.select(F.col("source_id").cast("string"), "module", "text", "attributes")
    return rows.mapInArrow(found, ", ".join(f"{c} {'int' if c in numbers else 'string'}" for c in columns))
