"""Rows that the queries over literal projects, schemas and documents must give: of each query the columns and the rows."""

GOLDENS: dict[str, tuple[str, list[tuple]]] = {
    "e_more_edges": (
        "src, dst, label, src_label, dst_label",
        [
            ("all.mjs", "m.mjs", "REEXPORT", "FILE", "FILE"),
            ("all.mjs", "x.mjs", "REEXPORT", "FILE", "FILE"),
            ("dyn.js", "dyn.js::late", "CONTAINS", "FILE", "FUNCTION"),
            ("dyn.js", "m.mjs", "REQUIRE", "FILE", "FILE"),
            ("dyn.js", "x.mjs", "DYNAMIC_IMPORT", "FILE", "FILE"),
            ("m.mjs", "m.mjs::Base", "CONTAINS", "FILE", "CLASS"),
            ("m.mjs", "m.mjs::go", "CONTAINS", "FILE", "FUNCTION"),
            ("m.mjs", "m.mjs::make", "CONTAINS", "FILE", "FUNCTION"),
            ("m.mjs", "m.mjs::run", "CONTAINS", "FILE", "FUNCTION"),
            ("m.mjs", "m.mjs::stop", "CONTAINS", "FILE", "FUNCTION"),
            ("m.mjs", "m.mjs::tag", "CONTAINS", "FILE", "FUNCTION"),
            ("m.mjs::Base", "m.mjs::Base.run", "METHOD_OF", "CLASS", "METHOD"),
            ("x.mjs", "m.mjs", "CALL", "FILE", "FILE"),
            ("x.mjs", "m.mjs", "EXTEND", "FILE", "FILE"),
            ("x.mjs", "m.mjs", "IMPORT", "FILE", "FILE"),
            ("x.mjs", "m.mjs::B", "CALL", "FILE", "CLASS"),
            ("x.mjs", "m.mjs::apply", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::call", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::go", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::make", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::make", "CALL_INDIRECT", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::stop", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "m.mjs::tag", "CALL", "FILE", "FUNCTION"),
            ("x.mjs", "x.mjs::K", "CONTAINS", "FILE", "CLASS"),
            ("x.mjs", "x.mjs::run", "CONTAINS", "FILE", "FUNCTION"),
            ("x.mjs::K", "x.mjs::K.run", "METHOD_OF", "CLASS", "METHOD"),
        ],
    ),
    "e_more_bindings": (
        "file, local, source_file, symbol_name, kind",
        [
            ("x.mjs", "B", "m.mjs", "Base", "import"),
            ("x.mjs", "cfg", "m.mjs", "cfg", "import"),
            ("x.mjs", "first", "m.mjs", "first", "array_destructure"),
            ("x.mjs", "inst", "m.mjs", "make", "factory_instance"),
            ("x.mjs", "left", "m.mjs", "left", "destructure"),
            ("x.mjs", "make", "m.mjs", "make", "import"),
            ("x.mjs", "other", "m.mjs", "make", "reassignment"),
            ("x.mjs", "tag", "m.mjs", "tag", "import"),
        ],
    ),
    "e_schema_names": (
        "src, dst, label, symbol, public",
        [
            ("x.mjs", "m.mjs", "IMPORT", "make", "make"),
            ("x.mjs", "m.mjs::go", "CALL", "go", "go"),
            ("x.mjs", "m.mjs::make", "CALL", "make", "make"),
        ],
    ),
    "e_documentation": (
        "id, jsdoc, returns, signature, async",
        [
            ("dyn.js::late", None, None, "late()", True),
            ("m.mjs::go", None, None, "go()", False),
            ("m.mjs::make", "Makes one.", "object", "make(kind) → object", False),
            ("m.mjs::run", None, None, "run()", False),
            ("m.mjs::stop", None, None, "stop()", False),
            ("m.mjs::tag", None, None, "tag(s)", False),
            ("x.mjs::run", None, None, "run()", False),
        ],
    ),
    "e_classes": (
        "file, name, above, methods",
        [
            ("m.mjs", "Base", None, "run"),
            ("x.mjs", "K", "B", "run"),
        ],
    ),
    "e_exports": (
        "file, name, type, source",
        [
            ("all.mjs", "*", "reexport", "./m.mjs"),
            ("all.mjs", "deep", "reexport", "./x.mjs"),
            ("dyn.js", "late", "function", None),
            ("m.mjs", "Base", "class", None),
            ("m.mjs", "cfg", "const", None),
            ("m.mjs", "make", "function", None),
            ("m.mjs", "tag", "const", None),
            ("x.mjs", "K", "class", None),
        ],
    ),
    "e_dynamic_imports": (
        "file, name, source",
        [
            ("dyn.js", "*", "./x.mjs"),
        ],
    ),
    "e_files": (
        "path, lines, functions, calls, broken",
        [
            ("all.mjs", 3, 0, "", False),
            ("bad.js", 1, 0, "", True),
            ("dyn.js", 3, 1, "", False),
            ("lone.mjs", 2, 0, "", False),
            ("m.mjs", 13, 5, "", False),
            ("x.mjs", 15, 1, "make,go,call,apply,f,stop", False),
        ],
    ),
    "g_edge_kinds": (
        "symbol, file, kind",
        [
            ("*", "lib/index.mjs", "namespace"),
            ("createStore", "lib/store.mjs", "function"),
            ("default", "b.mjs", "unknown"),
            ("helper", "lib/store.mjs", "function"),
            ("hidden", "lib/store.mjs", "function"),
            ("main", "a.mjs", "function"),
            ("z", "./missing.mjs", "unknown"),
        ],
    ),
    "g_file_views": (
        "part, id",
        [
            ("files", "a.mjs"),
            ("files", "b.mjs"),
            ("files", "lib/index.mjs"),
            ("files", "lib/store.mjs"),
            ("of lib/store.mjs", "lib/store.mjs"),
            ("of lib/store.mjs", "lib/store.mjs::createStore"),
            ("of lib/store.mjs", "lib/store.mjs::helper"),
            ("of lib/store.mjs", "lib/store.mjs::hidden"),
            ("of lib/store.mjs", "lib/store.mjs::load"),
            ("of lib/store.mjs", "lib/store.mjs::save"),
            ("symbols", "a.mjs::main"),
            ("symbols", "b.mjs::run"),
            ("symbols", "lib/index.mjs::Base"),
            ("symbols", "lib/index.mjs::Base.go"),
            ("symbols", "lib/index.mjs::Kid"),
            ("symbols", "lib/index.mjs::Kid.stop"),
            ("symbols", "lib/index.mjs::go"),
            ("symbols", "lib/index.mjs::stop"),
            ("symbols", "lib/store.mjs::createStore"),
            ("symbols", "lib/store.mjs::helper"),
            ("symbols", "lib/store.mjs::hidden"),
            ("symbols", "lib/store.mjs::load"),
            ("symbols", "lib/store.mjs::save"),
        ],
    ),
    "a_louvain_triangles": (
        "id, community",
        [
            ("a", 0),
            ("b", 0),
            ("c", 0),
            ("d", 1),
            ("e", 1),
            ("f", 1),
        ],
    ),
    "a_clusters_triangles": (
        "community, members, size, modularity",
        [
            (0, "a,b,c", 3, 0.178571),
            (1, "d,e,f", 3, 0.178571),
        ],
    ),
    "a_hot_paths_shape": (
        "rank, path, length",
        [
            (0, "a>b>c>d>b", 5),
            (1, "e>f>g", 3),
        ],
    ),
    "a_cycles_shape": (
        "k, path, length, cross_file",
        [
            (0, "a>b>c", 3, True),
            (1, "c>d", 2, True),
            (2, "d", 1, False),
        ],
    ),
    "a_depth_first_shape": (
        "id, position",
        [
            ("a", 2),
            ("b", 0),
            ("c", 1),
            ("d", 4),
            ("e", 3),
        ],
    ),
    "a_topo_order_shape": (
        "id, position",
        [
            ("a", 0),
            ("b", 1),
            ("c", 2),
            ("d", 4),
            ("e", 3),
        ],
    ),
    "a_centrality_shape": (
        "id, file, symbol, betweenness, pagerank, closeness, hub, authority, degree",
        [
            ("a", "a", None, 0.0, 0.144, 0.8, 1.0, 0.0, 3),
            ("b", "b", None, 0.0, 0.185, 0.0, 0.0, 0.333, 1),
            ("c", "c", None, 0.0, 0.185, 0.0, 0.0, 0.333, 1),
            ("d", "d", None, 0.083, 0.185, 0.25, 0.0, 0.333, 2),
            ("e", "e", None, 0.0, 0.301, 0.0, 0.0, 0.0, 1),
        ],
    ),
    "q_symbol_in_out": (
        "direction, src, dst, label",
        [
            ("in", "b.mjs::run", "lib/store.mjs::hidden", "CALL"),
            ("in", "lib/store.mjs", "lib/store.mjs::hidden", "CONTAINS"),
            ("out", "a.mjs::main", "b.mjs::default", "CALL"),
            ("out", "a.mjs::main", "lib/store.mjs::createStore", "CALL"),
            ("out", "a.mjs::main", "lib/store.mjs::helper", "CALL"),
        ],
    ),
    "q_all_symbols": (
        "id, label, exported",
        [
            ("a.mjs::main", "FUNCTION", True),
            ("b.mjs::run", "FUNCTION", True),
            ("lib/index.mjs::Base", "CLASS", True),
            ("lib/index.mjs::Base.go", "METHOD", True),
            ("lib/index.mjs::Kid", "CLASS", True),
            ("lib/index.mjs::Kid.stop", "METHOD", True),
            ("lib/index.mjs::go", "FUNCTION", False),
            ("lib/index.mjs::stop", "FUNCTION", False),
            ("lib/store.mjs::createStore", "FUNCTION", True),
            ("lib/store.mjs::helper", "FUNCTION", True),
            ("lib/store.mjs::hidden", "FUNCTION", False),
            ("lib/store.mjs::load", "FUNCTION", True),
            ("lib/store.mjs::save", "FUNCTION", True),
        ],
    ),
    "q_cypher_print": (
        "k, line, of",
        [
            (0, "a.mjs\tb.mjs", 5),
            (1, "a.mjs\tlib/index.mjs", 5),
            (2, "a.mjs\tlib/store.mjs", 5),
            (3, "b.mjs\ta.mjs", 5),
            (4, "b.mjs\tlib/store.mjs", 5),
        ],
    ),
    "q_analyze": (
        "part, n, formats",
        [
            ("advice", 15, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("centrality", 17, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("clusters", 8, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("complexity", 4, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("cycles", 1, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("duplicate_instantiations", 1, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("edges", 27, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("files", 4, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("hot_paths", 3, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("nodes", 17, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("registry", 3, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("schema_audit", 10, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("schema_gaps", 7, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("stats", 1, "text,json,mermaid,dot,swimlane,graph,summary,table"),
            ("violations", 1, "text,json,mermaid,dot,swimlane,graph,summary,table"),
        ],
    ),
    "k_report": (
        "k, line",
        [
            (0, "# Graph Analysis — corpus"),
            (2, ""),
            (3, "## Summary"),
            (4, ""),
            (5, "  Files              4"),
            (6, "  Edges             27"),
            (7, "  Violations         0"),
            (8, "  False pos.         1"),
            (9, "  Orphans            0"),
            (10, "  Complex            4"),
            (11, "  Max depth          3"),
            (12, "  Cycles             1 !!"),
            (13, "  Max fan-in         3"),
            (14, "  Max fan-out        7"),
            (15, "  Longest path       4"),
            (16, "  Dup. instances     1"),
            (17, ""),
            (18, "## Encapsulation Violations"),
            (19, ""),
            (20, "  (none)"),
            (21, ""),
            (22, "## Circular Dependencies"),
            (23, ""),
            (24, "  1. a.mjs → b.mjs → a.mjs"),
            (25, ""),
            (26, "## Dependency Chains"),
            (27, ""),
            (28, "  4 hops:"),
            (29, "    a.mjs"),
            (30, "    → b.mjs"),
            (31, "    → lib/store.mjs"),
            (32, "    → lib/store.mjs::createStore"),
            (33, "  3 hops:"),
            (34, "    lib/index.mjs"),
            (35, "    → lib/store.mjs"),
            (36, "    → lib/store.mjs::createStore"),
            (37, "  2 hops:"),
            (38, "    a.mjs::main"),
            (39, "    → lib/store.mjs::createStore"),
            (40, ""),
            (41, "## File Details"),
            (42, ""),
            (43, "  file                                                fn  exp int ratio calls   in out depth  lines"),
            (44, "  ────────────────────────────────────────────────── ─── ──── ─── ───── ───── ──── ─── ───── ──────"),
            (45, "  a.mjs                                                1    1   0   0.0     5    1   7     3     13"),
            (46, "  b.mjs                                                1    1   0   0.0     2    1   4     2      5"),
            (47, "  lib/index.mjs                                        2    3   2   0.7     0    1   5     2      4"),
            (48, "  lib/store.mjs                                        5    2   1   0.5     1    3   5     1      8"),
            (49, ""),
            (50, "## Function Centrality (top 10)"),
            (51, ""),
            (52, "  lib/index.mjs::Base                                          betw=0.013 pr=0.047"),
            (53, "  lib/index.mjs::Kid                                           betw=0.013 pr=0.047"),
            (54, "  a.mjs::main                                                  betw=0.003 pr=0.047"),
            (55, "  b.mjs::run                                                   betw=0.002 pr=0.049"),
            (56, "  lib/index.mjs::go                                            betw=0.000 pr=0.047"),
            (57, "  lib/index.mjs::stop                                          betw=0.000 pr=0.047"),
            (58, "  lib/index.mjs::Base.go                                       betw=0.000 pr=0.079"),
            (59, "  lib/index.mjs::Kid.stop                                      betw=0.000 pr=0.079"),
            (60, "  lib/store.mjs::createStore                                   betw=0.000 pr=0.080"),
            (61, "  lib/store.mjs::save                                          betw=0.000 pr=0.058"),
            (62, ""),
            (63, "## Schema Drift"),
            (64, ""),
            (65, "  Exported but not in schema:"),
            (66, "    a.mjs: main"),
            (67, "    lib/store.mjs: helper"),
            (68, "  In schema but not exported (stale):"),
            (69, "    a.mjs: gone"),
            (70, "    lib/store.mjs: hidden"),
            (71, ""),
            (72, "## Schema Audit"),
            (73, ""),
            (74, "  Definitions: 5"),
            (75, "  Properties:  3"),
            (76, "  $ref edges:  5"),
            (77, ""),
            (78, "  Dead definitions (3):"),
            (79, "    schema::hub.json#Root"),
            (80, "    schema::schema/a.json#Dead"),
            (81, "    schema::schema/b.json#Dead"),
            (82, ""),
            (83, "  Broken $ref (1):"),
            (84, "    schema::schema/b.json#B → schema::schema/b.json#Gone"),
            (85, ""),
            (86, "  $ref cycles (1):"),
            (87, "    schema::schema/a.json#A → schema::schema/b.json#B"),
            (88, ""),
            (89, "  Duplicate names: Dead"),
            (90, ""),
            (91, "  Orphan schema files: hub.json"),
            (92, ""),
            (93, "## False Positives (name collisions)"),
            (94, ""),
            (95, "  lib/store.mjs: hidden"),
            (96, ""),
            (97, "## Recommendations"),
            (98, ""),
            (99, "  !! Break Cycles (1)"),
            (100, "     a.mjs"),
            (101, "       Cycle: a.mjs → b.mjs → a.mjs"),
            (102, "  !  Sync Schema (2)"),
            (103, "     a.mjs"),
            (104, "       main is exported, but the schema lacks it."),
            (105, "     lib/store.mjs"),
            (106, "       helper is exported, but the schema lacks it."),
            (107, "  !  Clean Stale Schema (5)"),
            (108, "     a.mjs"),
            (109, "       gone differs between schema and code."),
            (110, "       stale_in_schema"),
            (111, "     a.mjs"),
            (112, "       gone differs between schema and code."),
            (113, "       stale_xmethod"),
            (114, "     lib/store.mjs"),
            (115, "       createStore differs between schema and code."),
            (116, "       no_xmethods"),
            (117, "     lib/store.mjs"),
            (118, "       hidden differs between schema and code."),
            (119, "       schema: 2, code: 1"),
            (120, "     lib/store.mjs"),
            (121, "       hidden differs between schema and code."),
            (122, "       stale_in_schema"),
            (123, "     Critical Paths (3)"),
            (124, "     a.mjs"),
            (125, "       Chain of 4: a.mjs → b.mjs → lib/store.mjs → lib/store.mjs::createStore"),
            (126, "     lib/index.mjs"),
            (127, "       Chain of 3: lib/index.mjs → lib/store.mjs → lib/store.mjs::createStore"),
            (128, "     a.mjs::main"),
            (129, "       Chain of 2: a.mjs::main → lib/store.mjs::createStore"),
            (130, "  !  Duplicate Instantiation (1)"),
            (131, "     lib/store.mjs"),
            (132, "       createStore is instantiated in 2 files."),
            (133, "       a.mjs, b.mjs"),
        ],
    ),
    "k_report_boxes": (
        "k, line",
        [
            (44, "┌───────────────┬────┬─────┬─────┬───────┬───────┬────┬─────┬───────┬───────┬───────┐"),
            (45, "│ file          │ fn │ exp │ int │ ratio │ calls │ in │ out │ depth │ lines │ notes │"),
            (46, "├───────────────┼────┼─────┼─────┼───────┼───────┼────┼─────┼───────┼───────┼───────┤"),
            (47, "│ a.mjs         │ 1  │ 1   │ 0   │ 0.000 │ 5     │ 1  │ 7   │ 3     │ 13    │       │"),
            (48, "│ b.mjs         │ 1  │ 1   │ 0   │ 0.000 │ 2     │ 1  │ 4   │ 2     │ 5     │       │"),
            (49, "│ lib/index.mjs │ 2  │ 3   │ 2   │ 0.700 │ 0     │ 1  │ 5   │ 2     │ 4     │       │"),
            (50, "│ lib/store.mjs │ 5  │ 2   │ 1   │ 0.500 │ 1     │ 3  │ 5   │ 1     │ 8     │ V1    │"),
            (51, "└───────────────┴────┴─────┴─────┴───────┴───────┴────┴─────┴───────┴───────┴───────┘"),
        ],
    ),
    "k_report_json": (
        "part, n",
        [
            ("advice", 15),
            ("centrality", 17),
            ("clusters", 8),
            ("complexity", 4),
            ("cycles", 1),
            ("duplicate_instantiations", 1),
            ("edges", 27),
            ("files", 4),
            ("hot_paths", 3),
            ("nodes", 17),
            ("registry", 3),
            ("schema_audit", 10),
            ("schema_gaps", 7),
            ("stats", 1),
            ("violations", 1),
        ],
    ),
    "k_one_line": (
        "k, line",
        [
            (0, "Files: 4 | Edges: 27 | Cycles: 1 | Violations: 0 | Orphans: 0"),
        ],
    ),
    "k_box": (
        "k, line",
        [
            (0, "┌────┬────────────────────────────────────────────────────┬──────┬───────┬───┐"),
            (1, "│ a  │ b                                                  │ c    │ d     │ e │"),
            (2, "├────┼────────────────────────────────────────────────────┼──────┼───────┼───┤"),
            (3, "│ 1  │ …xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx │ 1, 2 │ 0.123 │   │"),
            (4, "│ 22 │ y                                                  │      │ 2.000 │ z │"),
            (5, "└────┴────────────────────────────────────────────────────┴──────┴───────┴───┘"),
        ],
    ),
    "k_modes": (
        "k, line",
        [
            (0, "Impact of hidden: 5"),
            (1, "depth 1 — WILL BREAK"),
            (2, "  b.mjs::run"),
            (3, "  lib/store.mjs"),
            (4, "depth 2 — LIKELY AFFECTED"),
            (5, "  a.mjs"),
            (6, "  b.mjs"),
            (7, "  lib/index.mjs"),
            (8, "context(hidden)"),
            (9, "  symbols: 1"),
            (10, "    lib/store.mjs:hidden [FUNCTION]"),
            (11, "  callers (d=1): 5"),
            (12, "    a.mjs →(IMPORT)→"),
            (13, "    b.mjs →(IMPORT)→"),
            (14, "    lib/index.mjs →(REEXPORT)→"),
            (15, "    b.mjs::run →(CALL)→"),
            (16, "    lib/store.mjs →(CONTAINS)→"),
            (17, "  callees (d=1): 5"),
            (18, "    →(CONTAINS)→ lib/store.mjs::createStore"),
            (19, "    →(CONTAINS)→ lib/store.mjs::helper"),
            (20, "    →(CONTAINS)→ lib/store.mjs::hidden"),
            (21, "    →(CONTAINS)→ lib/store.mjs::load"),
            (22, "    →(CONTAINS)→ lib/store.mjs::save"),
            (23, "context(nothing)"),
            (24, "  target not found in graph"),
            (25, "clusters: 8"),
            (26, "  [3] 4"),
            (27, "    lib/index.mjs"),
            (28, "    lib/index.mjs::go"),
            (29, "    lib/index.mjs::stop"),
            (30, "  [2] 0"),
            (31, "    a.mjs"),
            (32, "    lib/store.mjs::save"),
            (33, "  [2] 1"),
            (34, "    a.mjs::main"),
            (35, "    lib/store.mjs::helper"),
            (36, "  [2] 2"),
            (37, "    b.mjs"),
            (38, "    lib/store.mjs::createStore"),
            (39, "  [2] 3"),
            (40, "    b.mjs::run"),
            (41, "    lib/store.mjs::hidden"),
            (42, "  [2] 5"),
            (43, "    lib/index.mjs::Base"),
            (44, "    lib/index.mjs::Base.go"),
            (45, "  [2] 6"),
            (46, "    lib/index.mjs::Kid"),
            (47, "    lib/index.mjs::Kid.stop"),
            (48, "  [2] 7"),
            (49, "    lib/store.mjs"),
            (50, "    lib/store.mjs::load"),
            (51, "schema-audit: 5 definitions, 5 refs, 3 properties"),
            (52, ""),
            (53, "  dead definitions (3):"),
            (54, "    schema::hub.json#Root"),
            (55, "    schema::schema/a.json#Dead"),
            (56, "    schema::schema/b.json#Dead"),
            (57, ""),
            (58, "  broken $ref (1):"),
            (59, "    schema::schema/b.json#B → schema::schema/b.json#Gone"),
            (60, ""),
            (61, "  $ref cycles (1):"),
            (62, "    schema::schema/a.json#A → schema::schema/b.json#B"),
            (63, ""),
            (64, "  duplicate names: Dead"),
            (65, ""),
            (66, "  orphan schema files: hub.json"),
            (67, "# Schema Block Analysis"),
            (68, ""),
            (69, "  5 definitions, 4 $ref edges"),
            (70, ""),
            (71, "## Suggested Blocks (Louvain clusters)"),
            (72, ""),
            (73, "  [3] cluster 0"),
            (74, "    hub.json#Root"),
            (75, "    schema/a.json#A"),
            (76, "    schema/b.json#B"),
            (77, "  [1] cluster 1"),
            (78, "    schema/a.json#Dead"),
            (79, "  [1] cluster 2"),
            (80, "    schema/b.json#Dead"),
            (81, ""),
            (82, "## $ref Cycles"),
            (83, "  schema/a.json#A → schema/b.json#B"),
            (84, ""),
            (85, "## File Alignment"),
            (86, ""),
            (87, "  1 clusters span multiple files:"),
            (88, "    cluster 0 (3): hub.json, schema/a.json, schema/b.json"),
            (89, ""),
            (90, "## Code Block Alignment"),
            (91, ""),
            (92, "  All clusters map to single code blocks"),
            (93, "processes: 9 (threshold=0.4)"),
            (94, ""),
            (95, "  entry: lib/index.mjs  depth=2  steps=10"),
            (96, "  terminals: lib/index.mjs::Base, lib/index.mjs::Kid, lib/index.mjs::go, lib/index.mjs::stop, lib/store.mjs::createStore, lib/store.mjs::helper, lib/store.mjs::hidden, lib/store.mjs::load, lib/store.mjs::save"),
            (97, ""),
            (98, "  entry: lib/index.mjs::go  depth=0  steps=0"),
            (99, ""),
            (100, "  entry: lib/index.mjs::stop  depth=0  steps=0"),
            (101, ""),
            (102, "  entry: lib/index.mjs::Base  depth=0  steps=0"),
            (103, ""),
            (104, "  entry: lib/index.mjs::Base.go  depth=0  steps=0"),
            (105, ""),
            (106, "  entry: lib/index.mjs::Kid  depth=0  steps=0"),
            (107, ""),
            (108, "  entry: lib/index.mjs::Kid.stop  depth=0  steps=0"),
            (109, ""),
            (110, "  entry: lib/store.mjs  depth=1  steps=5"),
            (111, "  terminals: lib/store.mjs::createStore, lib/store.mjs::helper, lib/store.mjs::hidden, lib/store.mjs::load, lib/store.mjs::save"),
            (112, ""),
            (113, "  entry: lib/store.mjs::createStore  depth=0  steps=0"),
            (114, "# Architecture Map"),
            (115, ""),
            (116, "  4 files, 11 functions and classes"),
            (117, ""),
            (118, "  lib/store.mjs  [in:3 out:0] 4 exp, 1 int"),
            (119, "    createStore()"),
            (120, "    helper(q)"),
            (121, "    load()"),
            (122, "    save(v)"),
            (123, "  a.mjs  [in:1 out:4] 1 exp, 0 int"),
            (124, "    main(x, y)"),
            (125, "    calls→ b.mjs::default, lib/index.mjs::util, lib/store.mjs::createStore, lib/store.mjs::helper, lib/store.mjs::save"),
            (126, "  b.mjs  [in:1 out:2] 1 exp, 0 int"),
            (127, "    run()"),
            (128, "    calls→ lib/store.mjs::createStore, lib/store.mjs::hidden"),
            (129, "  lib/index.mjs  [in:1 out:1] 2 exp, 2 int"),
            (130, "    Base"),
            (131, "    Kid"),
        ],
    ),
    "k_swimlane": (
        "k, line",
        [
            (0, "b ╤═╧"),
            (1, "  │ │"),
            (2, "c ╧╤╪"),
            (3, "   ││"),
            (4, "a ═╧╤"),
        ],
    ),
    "k_swimlane_of_a_graph": (
        "k, line",
        [
            (0, "a ═╤╤"),
            (1, "   ││"),
            (2, "b ╤╧╧"),
        ],
    ),
    "k_dot": (
        "k, line",
        [
            (0, "digraph G {"),
            (1, "  rankdir=LR;"),
            (2, "  node [shape=box];"),
            (3, "  \"a.mjs\";"),
            (4, "  \"b.mjs\";"),
            (5, "  \"lib/index.mjs\";"),
            (6, "  \"lib/store.mjs\";"),
            (7, "  \"a.mjs\" -> \"lib/store.mjs\";"),
            (8, "  \"a.mjs\" -> \"b.mjs\";"),
            (9, "  \"a.mjs\" -> \"lib/index.mjs\";"),
            (10, "  \"a.mjs\" -> \"./missing.mjs\";"),
            (11, "  \"b.mjs\" -> \"lib/store.mjs\";"),
            (12, "  \"b.mjs\" -> \"a.mjs\";"),
            (13, "  \"lib/index.mjs\" -> \"lib/store.mjs\";"),
            (14, "}"),
        ],
    ),
    "k_mermaid": (
        "k, line",
        [
            (0, "graph LR"),
            (1, "  n0[\"a.mjs\"]"),
            (2, "  n1[\"b.mjs\"]"),
            (3, "  n2[\"lib/index.mjs\"]"),
            (4, "  n3[\"lib/store.mjs\"]"),
            (5, "  n0 --> n3"),
            (6, "  n0 --> n1"),
            (7, "  n0 --> n2"),
            (8, "  n1 --> n3"),
            (9, "  n1 --> n0"),
            (10, "  n2 --> n3"),
        ],
    ),
    "k_gate": (
        "project, passes",
        [
            ("with registry", True),
            ("without registry", False),
        ],
    ),
    "n_orphan_files": (
        "path",
        [
            ("lone.mjs",),
        ],
    ),
    "n_all_entry_points": (
        "file, score, reasons, fan_in, fan_out",
        [
            ("a.mjs", 0.13, "fan_in:1", 1, 7),
            ("a.mjs::main", 0.13, "fan_in:1", 1, 3),
            ("b.mjs", 0.13, "fan_in:1", 1, 4),
            ("b.mjs::run", 0.13, "fan_in:1", 1, 1),
            ("lib/index.mjs", 0.53, "name:index,fan_in:1", 1, 5),
            ("lib/index.mjs::Base", 0.53, "name:index,fan_in:1", 1, 1),
            ("lib/index.mjs::Base.go", 0.63, "name:index,fan_in:1,fan_in_dominant", 1, 0),
            ("lib/index.mjs::Kid", 0.53, "name:index,fan_in:1", 1, 1),
            ("lib/index.mjs::Kid.stop", 0.63, "name:index,fan_in:1,fan_in_dominant", 1, 0),
            ("lib/index.mjs::go", 0.63, "name:index,fan_in:1,fan_in_dominant", 1, 0),
            ("lib/index.mjs::stop", 0.63, "name:index,fan_in:1,fan_in_dominant", 1, 0),
            ("lib/store.mjs", 0.4, "fan_in:3", 3, 5),
            ("lib/store.mjs::createStore", 0.5, "fan_in:3,fan_in_dominant", 3, 0),
            ("lib/store.mjs::helper", 0.37, "fan_in:2,fan_in_dominant", 2, 0),
            ("lib/store.mjs::hidden", 0.37, "fan_in:2,fan_in_dominant", 2, 0),
            ("lib/store.mjs::load", 0.23, "fan_in:1,fan_in_dominant", 1, 0),
            ("lib/store.mjs::save", 0.37, "fan_in:2,fan_in_dominant", 2, 0),
        ],
    ),
    "n_all_processes": (
        "entry, depth, steps, terminals",
        [
            ("lib/index.mjs", 2, "lib/store.mjs,lib/index.mjs::go,lib/index.mjs::stop,lib/index.mjs::Base,lib/index.mjs::Kid,lib/store.mjs::createStore,lib/store.mjs::save,lib/store.mjs::load,lib/store.mjs::hidden,lib/store.mjs::helper", "lib/index.mjs::Base,lib/index.mjs::Kid,lib/index.mjs::go,lib/index.mjs::stop,lib/store.mjs::createStore,lib/store.mjs::helper,lib/store.mjs::hidden,lib/store.mjs::load,lib/store.mjs::save"),
            ("lib/index.mjs::Base", 0, "", ""),
            ("lib/index.mjs::Base.go", 0, "", ""),
            ("lib/index.mjs::Kid", 0, "", ""),
            ("lib/index.mjs::Kid.stop", 0, "", ""),
            ("lib/index.mjs::go", 0, "", ""),
            ("lib/index.mjs::stop", 0, "", ""),
            ("lib/store.mjs", 1, "lib/store.mjs::createStore,lib/store.mjs::save,lib/store.mjs::load,lib/store.mjs::hidden,lib/store.mjs::helper", "lib/store.mjs::createStore,lib/store.mjs::helper,lib/store.mjs::hidden,lib/store.mjs::load,lib/store.mjs::save"),
            ("lib/store.mjs::createStore", 0, "", ""),
        ],
    ),
    "n_all_advice": (
        "type, severity, file, message",
        [
            ("bottleneck", "warning", "lib/index.mjs", "Bottleneck of dependencies, betweenness 0.05"),
            ("bottleneck", "warning", "lib/store.mjs", "Bottleneck of dependencies, betweenness 0.05"),
            ("cycle", "error", "a.mjs", "Cycle: a.mjs → b.mjs → a.mjs"),
            ("duplicate_instantiation", "warning", "lib/store.mjs", "createStore is instantiated in 2 files."),
            ("hot_path", "info", "a.mjs", "Chain of 4: a.mjs → b.mjs → lib/store.mjs → lib/store.mjs::createStore"),
            ("hot_path", "info", "a.mjs::main", "Chain of 2: a.mjs::main → lib/store.mjs::createStore"),
            ("hot_path", "info", "lib/index.mjs", "Chain of 3: lib/index.mjs → lib/store.mjs → lib/store.mjs::createStore"),
            ("poor_separation", "info", "project", "Clusters are poorly separated, modularity 0.03"),
            ("violation", "error", "lib/store.mjs", "hidden is not exported, but b.mjs calls it: export it, or change the caller."),
        ],
    ),
    "n_whole_map": (
        "file, fan_in, fan_out, exports, internals, imports, calls_out",
        [
            ("a.mjs", 1, 4, "main(x, y)", "", "./b.mjs; ./lib/index.mjs; ./lib/store.mjs; ./missing.mjs", "b.mjs::default; lib/index.mjs::util; lib/store.mjs::createStore; lib/store.mjs::helper; lib/store.mjs::save"),
            ("b.mjs", 1, 2, "run()", "", "./a.mjs; ./lib/store.mjs", "lib/store.mjs::createStore; lib/store.mjs::hidden"),
            ("lib/index.mjs", 1, 1, "Base; Kid", "go; stop", "", None),
            ("lib/store.mjs", 3, 0, "createStore(); helper(q); load(); save(v)", "hidden", "", None),
        ],
    ),
    "n_whole_stats": (
        "name, value",
        [
            ("avg_betweenness", 0.0098),
            ("avg_clustering_coefficient", 0.1683),
            ("boundary_violations", 1.0),
            ("complex_files", 4.0),
            ("confirmed_violations", 0.0),
            ("cross_file_calls", 7.0),
            ("cycles", 1.0),
            ("duplicate_instantiations", 1.0),
            ("false_positives", 1.0),
            ("longest_path", 4.0),
            ("max_betweenness", 0.05),
            ("max_depth", 3.0),
            ("max_fan_in", 3.0),
            ("max_fan_out", 7.0),
            ("max_pagerank", 0.0916),
            ("modularity", 0.0293),
            ("num_clusters", 8.0),
            ("orphan_nodes", 0.0),
            ("total_call_edges", 7.0),
            ("total_contains_edges", 11.0),
            ("total_edges", 27.0),
            ("total_files", 4.0),
            ("total_symbols", 13.0),
        ],
    ),
    "n_all_schema_blocks": (
        "kind, item, members, score",
        [
            ("cluster", "0", "hub.json#Root,schema/a.json#A,schema/b.json#B", 3.0),
            ("cluster", "1", "schema/a.json#Dead", 1.0),
            ("cluster", "2", "schema/b.json#Dead", 1.0),
            ("cycle", "schema/a.json#A", "schema/a.json#A,schema/b.json#B", 2.0),
        ],
    ),
    "n_schema_file_alignment": (
        "cluster, size, parts, aligned, primary, spillover",
        [
            ("0", 3, "hub.json:1,schema/a.json:1,schema/b.json:1", False, "hub.json", "schema/a.json,schema/b.json"),
            ("1", 1, "schema/a.json:1", True, "schema/a.json", ""),
            ("2", 1, "schema/b.json:1", True, "schema/b.json", ""),
        ],
    ),
    "n_schema_block_alignment": (
        "cluster, size, parts, aligned, primary, spillover, mixed",
        [
            ("0", 3, "first:1,second:1,system:1", False, "first", "second,system", True),
            ("1", 1, "first:1", True, "first", "", False),
            ("2", 1, "second:1", True, "second", "", False),
        ],
    ),
    "s_scan": (
        "ord, path, text, same_root",
        [
            (0, "d/t.txt", "t", True),
            (1, "_a.mjs", "x\n", True),
            (2, "a[1].js", "y", True),
            (3, "b.js", "", True),
            (4, "d/c.js", "é", True),
            (5, "d/e/f g.mjs", "z", True),
        ],
    ),
    "s_schema_scan": (
        "path, n",
        [
            ("hub.json", 169),
            ("schema/a.json", 133),
            ("schema/b.json", 119),
        ],
    ),
    "s_registries": (
        "way, file, method, has_xmethod, param_count",
        [
            ("file", "a.mjs", "main", False, None),
            ("file", "lib/store.mjs", "createStore", False, None),
            ("file", "lib/store.mjs", "hidden", False, None),
            ("found", "a.mjs", "main", True, 2),
            ("found", "b.mjs", "run", True, 2),
            ("found", "lib/store.mjs", "createStore", True, 0),
            ("found", "lib/store.mjs", "helper", True, None),
            ("hub file", "b.mjs", "run", False, None),
            ("schemas", "a.mjs", "main", True, 2),
        ],
    ),
    "s_entry_points": (
        "file",
        [
            ("a.mjs",),
            ("lib/index.mjs",),
        ],
    ),
    "s_staleness": (
        "cache, stale",
        [
            ("missing", True),
            ("newer", False),
            ("older", True),
        ],
    ),
    "j_loader": (
        "ref, found",
        [
            ("#/definitions/n~0~1%25", "{\"type\": \"integer\"}"),
            ("#/definitions/t/type", "\"string\""),
            ("#t", "{\"$id\": \"#t\", \"type\": \"string\"}"),
            ("other#/d", "{\"const\": 1}"),
        ],
    ),
    "j_error_places": (
        "id, valid, place",
        [
            (1, False, "$.l[1]"),
            (2, False, "$.a"),
            (3, False, "$"),
            (4, False, "$"),
            (5, False, "$"),
        ],
    ),
    "j_document": (
        "what, value",
        [
            ("changed o.x", "9"),
            ("contains a", "false"),
            ("contains l", "true"),
            ("dict", "{\"a\": 1, \"b\": null, \"l\": [{\"y\": 3}], \"o\": {}}"),
            ("get a", "1"),
            ("get l.0.y", "3"),
            ("get none", "null"),
            ("json", "{\"b\": null, \"l\": [{}]}"),
            ("list contains", "true"),
            ("old o", "{}"),
            ("replaced", "{\"a\": 5, \"o\": {}}"),
            ("schema", "[\"properties\", \"type\", \"x-top\"]"),
            ("value", "{\"a\": 1, \"b\": null, \"l\": [{\"y\": 3}], \"o\": {}}"),
        ],
    ),
    "j_schema_places": (
        "path, extensions",
        [
            ("", "{\"x-a\": 1}"),
            ("none", "{}"),
            ("p", "{\"x-b\": 2}"),
            ("p.*", "{\"x-c\": 3}"),
            ("p.0", "{\"x-c\": 3}"),
            ("q", "{\"x-d\": 5}"),
            ("zz", "{\"x-z\": 4}"),
        ],
    ),
    "j_branches": (
        "value, one_of, any_of, branch, not_of",
        [
            ("\"s\"", 0, "0,1", "e", True),
            ("1", 1, "0", "t", True),
            ("3", 1, "0", "e", False),
            ("6", 1, "0,1", "e", True),
            ("null", None, "0,1", "e", True),
        ],
    ),
    "j_all_of": (
        "key, value",
        [
            ("properties", "{\"a\": {}, \"b\": {\"type\": \"string\"}}"),
            ("required", "[\"a\", \"b\", \"c\"]"),
        ],
    ),
    "j_hub": (
        "name, items",
        [
            ("Kind", "CALL"),
            ("Label", "FILE,CLASS"),
            ("by reference", "FILE,CLASS"),
        ],
    ),
    "f_numbers": (
        "x, whole, two, one, after_, before_",
        [
            (-0.5, 0.0, -0.5, -0.5, "ab  ", "  ab"),
            (0.25, 0.0, 0.25, 0.3, "ab  ", "  ab"),
            (0.35, 0.0, 0.35, 0.3, "ab  ", "  ab"),
            (1.005, 1.0, 1.0, 1.0, "ab  ", "  ab"),
            (2.5, 3.0, 2.5, 2.5, "ab  ", "  ab"),
        ],
    ),
}
