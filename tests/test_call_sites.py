"""Call sites, what they name, and their resolution."""

from quarry.functions.call_sites import CallSite, Known, call_sites, call_sites_of, factories, factories_of, known_names
from quarry.operators import graph

KNOWN = Known(frozenset({"stock", "common", "helpers"}), {"справочник": frozenset({"items"}), "отчет": frozenset({"sales"})}, {}, frozenset({"message", "format"}), frozenset({"add", "count"}))


def named(text, **more):
    return [(c.caller, c.line, c.kind, c.callee_module, c.callee) for c in call_sites(text, KNOWN, **more)]


def test_kinds():
    text = """Procedure Main(Param)
    Stock.Recount(1); Local(2); Message("x"); Main(3);
    Catalogs.Items.Fill(); Catalogs.Gone.Fill(); Catalogs.Items.FindByCode(1); Reports.Sales.Make(); Reports.Other.Make();
    Param.Recount(); unknown.Recount(); Unknown.Recount(); X.Recount(); New Structure("Not(1)");
EndProcedure
Procedure Local(A)
EndProcedure"""
    assert named(text) == [
        ("Main", 2, "common_module", "Stock", "Recount"), ("Main", 2, "local", "", "Local"),
        ("Main", 3, "manager", "Справочник.Items.МодульМенеджера", "Fill"), ("Main", 3, "manager_object", "Справочник.Items.МодульМенеджера", "FindByCode"), ("Main", 3, "manager", "Отчет.Sales.МодульМенеджера", "Make"),
        ("Main", 4, "common_module", "Unknown", "Recount"),
    ]


def test_values_and_aliases():
    text = """Procedure P()
    A = New Structure; A.Recount(); B = A.Next(); B.Recount(); C = Rows[0]; C.Recount();
    M = Stock; M.Recount();
    L = Common.CommonModule("Helpers"); L.Help();
    G = Catalogs.Items; G.Fill(); G.FindByCode(1);
    F = Common.ObjectManagerByFullName("Catalog.Items"); F.Fill2();
    E = Eval("Stock"); E.Recount2(); Z = Eval("1 + 1"); Z.Recount();
    For Each Row In Rows Do Row.Recount(); EndDo;
    Chain = Catalogs.Items
        .Select(); Chain.Recount();
EndProcedure"""
    assert [x[2:] for x in named(text) if x[4] not in ("Next", "CommonModule", "ObjectManagerByFullName", "Select", "Eval")] == [
        ("common_module", "Stock", "Recount"), ("common_module", "Helpers", "Help"), ("manager", "Справочник.Items.МодульМенеджера", "Fill"),
        ("manager", "Справочник.Items.МодульМенеджера", "Fill2"), ("common_module", "Stock", "Recount2"),
    ]


def test_assignments_reach_through_blocks():
    text = """Procedure P(Flag)
    If Flag Then
        M = Catalogs.Items;
        M.Inside();
    Else
        M = Reports.Sales;
        M.Other();
    EndIf;
    M.Unsure();
    M = Catalogs.Items;
    M.Sure();
    If Flag Then M = 5; EndIf;
    M.MaybeValue();
EndProcedure"""
    assert [x[3:] for x in named(text)] == [("Справочник.Items.МодульМенеджера", "Inside"), ("Отчет.Sales.МодульМенеджера", "Other"), ("Справочник.Items.МодульМенеджера", "Sure")]


def test_interceptors_form_attributes_and_factories():
    text = """&Around("Old")
Procedure Ext_Old()
    ProceedWithCall(); Table.Sort(); Stock.Recount(); Stock.Recount();
EndProcedure
Function Make() Export
    T = New ValueTable;
    Return T;
EndFunction
Function Sheet() Export
    Return Reports.Sales.GetTemplate("x");
EndFunction
Function Plain(P) Export
    Return P;
EndFunction"""
    assert named(text, attributes=frozenset({"table"}))[:3] == [("Ext_Old", 2, "override", "", "Old"), ("Ext_Old", 3, "override", "", "Old"), ("Ext_Old", 3, "common_module", "Stock", "Recount")]
    assert factories(text) == ["make", "sheet"] and call_sites("") == [] and call_sites("no code(1)") == []


def test_call_sites_of_tables(spark):
    modules = spark.createDataFrame([("main", "ОбщийМодуль.Stock.Модуль", "Procedure Aa() Export\nBb(1);\nEndProcedure\nProcedure Bb(X)\nHelpers.Help();\nEndProcedure", []), ("main", "empty", None, None)], "source_id string, module string, text string, attributes array<string>")
    names = known_names(spark.createDataFrame([("Stock",), ("Helpers",)], "module string"), spark.createDataFrame([("Справочник", "Items")], "kind string, name string"), factories_of(modules))
    rows = call_sites_of(modules, names).collect()
    assert [(r.caller, r.line, r.kind, r.callee_module, r.callee) for r in rows] == [("Aa", 2, "local", "", "Bb"), ("Bb", 5, "common_module", "Helpers", "Help")]


def plain_resolve(calls, procedures, modules, sources, platform):
    """The rules one by one, call by call."""
    type_of = dict(sources)
    is_global = {(s, m) for s, m, g in modules if g}
    out = {}
    for c in calls:
        cid, source, module, _, kind, callee_module, callee = c
        callee, named_ = callee.lower(), (callee_module or "").lower()
        here = [p for p in procedures if p[1] == source and p[2].lower() == module.lower() and p[3].lower() == callee]
        key = {"local": module.lower(), "common_module": f"общиймодуль.{named_}.модуль"}.get(kind, named_)
        inside = [p for p in procedures if p[3].lower() == callee and key in ({p[2].lower()} | ({f"общиймодуль.{p[2].lower()}.модуль"} if "." not in p[2] else set()))]
        best = lambda pool, first: min(pool, key=lambda p: (type_of[p[1]] != first, p[0]))[0]
        found = (None, None)
        if kind == "local":
            exported = [p for p in procedures if p[3].lower() == callee and p[4] and (p[1], p[2]) in is_global]
            found = (max(p[0] for p in here), "exact") if here else (best(exported, "extension"), "name_only") if exported else found
        elif kind == "override":
            pool = [p for p in inside if p[1] != source]
            found = (best(pool, "main"), "override") if pool else found
        elif inside and not (kind == "manager_object" and (key.split(".")[0], callee) in platform):
            found = (best(inside, "extension"), "exact")
        out[cid] = found
    return out


def test_resolution_by_all_rules(spark):
    import random

    rng = random.Random(4)
    sources = [("main", "main"), ("ext1", "extension"), ("ext2", "extension")]
    names = ["ОбщийМодуль.A.Модуль", "ОбщийМодуль.B.Модуль", "C", "ОбщийМодуль.C.Модуль", "Справочник.X.МодульМенеджера", "Документ.Y.МодульМенеджера"]
    modules = [(s, m, rng.random() < 0.4) for s, _ in sources for m in names]
    procedures = [(i, *rng.choice(modules)[:2], rng.choice(["Run", "run", "Fill", "Find", "Post"]), rng.random() < 0.5) for i in range(60)]
    calls = []
    for i in range(400):
        s, m, _ = rng.choice(modules)
        kind = rng.choice(["local", "common_module", "manager", "manager_object", "override"])
        target = rng.choice(["A", "B", "C", "D"]) if kind == "common_module" else m if kind == "override" else rng.choice(names)
        calls.append((i, s, m, "P", kind, None if kind == "local" else target, rng.choice(["RUN", "fill", "Find", "Post", "None"])))
    platform = {("справочник", "find")}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = graph.resolve_calls(
        frame(calls, "call_id long, source_id string, module string, caller string, kind string, callee_module string, callee string"), frame(procedures, "proc_id long, source_id string, module string, procedure string, is_export boolean"),
        frame(modules, "source_id string, module string, is_global boolean"), frame(sources, "source_id string, source_type string"), frame([("Справочник", "Find")], "kind string, method string"),
    ).collect()
    assert {r.call_id: (r.target, r.confidence) for r in found} == plain_resolve(calls, procedures, modules, sources, platform) and len(found) == 400


def plain_tree(lines, roots, depth, most):
    """Depth first, as it is told."""
    out, count = [], 1

    def grow(node, level, visited, parent):
        nonlocal count
        if level >= depth or node in visited or count >= most:
            return
        visited.add(node)
        for target, name in lines.get(node, []):
            if count >= most:
                break
            count += 1
            out.append((len(out), parent, level + 1, target, name))
            if target is not None and target not in visited:
                grow(target, level + 1, visited, len(out) - 1)

    for r in roots:
        count += len(roots) > 1
        out.append((len(out), None, 0, r, f"m.p{r}"))
        grow(r, 0, set(), len(out) - 1)
    return out, count >= most


def test_call_trees(spark):
    import random

    rng = random.Random(6)
    n = 40
    procedures = spark.createDataFrame([(i, "main", "m", f"p{i}") for i in range(n)], "proc_id long, source_id string, module string, procedure string")
    calls = [(k, rng.randrange(n), rng.randrange(1, 30), t if t < n else None, "exact" if t < n else None, f"p{t}", "m" if t < n else "", "local") for k, t in enumerate(rng.randrange(n + 6) for _ in range(150))]
    resolved = spark.createDataFrame(calls, "call_id long, proc_id long, line int, target long, confidence string, callee string, callee_module string, kind string")
    down, up = graph.callees(resolved), graph.callers(resolved, procedures)
    for lines_frame in (down, up):
        lines = {}
        for r in lines_frame.orderBy("node", "pos").collect():
            lines.setdefault(r.node, []).append((r.target, f"m.p{r.target}" if r.target is not None else r.name))
        for roots, depth, most in (([3], 3, 200), ([3], 4, 17), ([5, 9, 2], 2, 40), ([1], 0, 200)):
            tree = graph.call_tree(lines_frame, procedures, spark.createDataFrame([(r,) for r in roots], "proc_id long"), depth, most).orderBy("pos").collect()
            wanted, full = plain_tree(lines, sorted(roots), depth, most)
            assert [(r.pos, r.parent, r.depth, r.node, r.name) for r in tree] == wanted and {r.truncated for r in tree} == {full}
    tree = graph.call_tree(down, procedures, spark.createDataFrame([(3,)], "proc_id long"), 3, 200)
    nodes, edges = graph.graph_of(tree)
    assert nodes.count() == tree.select("name").distinct().count() and edges.count() <= tree.count()


def test_intercepts(spark):
    procedures = spark.createDataFrame([(1, "main", "m", "Old", 5, ""), (2, "ext", "m", "Ext_Old", 9, "&Around:Old")], "proc_id long, source_id string, module string, procedure string, start_line int, directive string")
    resolved = spark.createDataFrame([(2, "ext", 9, 1, "override"), (2, "ext", 11, 1, "override")], "proc_id long, source_id string, line int, target long, confidence string")
    assert [tuple(r) for r in graph.intercepts(resolved, procedures).collect()] == [("m", "Old", "ext", "Ext_Old", "&Around:Old")]


def test_enclosing_ranges(spark):
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 99, 3), ("a", 300, 4), ("b", 5, 5), ("c", 1, 6)], "g string, at int, id int")
    ranges = spark.createDataFrame([("a", 1, 200, 10), ("a", 4, 6, 11), ("a", 4, 9, 12), ("b", 9, 12, 13)], "g string, first int, last int, key int")
    found = graph.enclosing(points, ranges, "g", "at", "first", "last", "key").collect()
    assert {r.id: r.key for r in found} == {1: 11, 2: 11, 3: 10, 4: None, 5: None, 6: None} and len(found) == 6
    assert CallSite._fields[0] == "caller"
