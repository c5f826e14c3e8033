"""The data model: labels, schemas and default parameters."""

from __future__ import annotations

# Node and edge labels.
NODE_LABELS = ("FILE", "FUNCTION", "CLASS", "METHOD", "VARIABLE", "NAMESPACE", "PARAMETER", "SCHEMA_FILE", "DEFINITION", "PROPERTY")
EDGE_LABELS = ("IMPORT", "DYNAMIC_IMPORT", "REQUIRE", "REEXPORT", "CONTAINS", "METHOD_OF", "CALL", "CALLBACK", "CALL_INDIRECT", "EXTEND", "DEFINES", "HAS_PROPERTY", "REF")

LOC = "struct<start:int,end:int,line:int>"
NODE_ATTRS = (
    "struct<async:boolean,generator:boolean,static:boolean,computed:boolean,arrow:boolean,abstract:boolean,lines:int,complexity:int,paramCount:int,params:array<string>,returns:string,"
    "jsdoc:string,signature:string,body:string,superClass:string,methods:array<string>,type:string,required:array<string>,hasXMethods:boolean,hasXSource:boolean,hasRef:boolean,refTarget:string>"
)
SYMBOLS = "array<struct<name:string,kind:string,schema:string>>"
EDGE_ATTRS = f"struct<resolved:boolean,dynamic:boolean,weight:double,symbols:{SYMBOLS}>"
NODES = f"ord long, id string, label string, name string, full_name string, file string, parent string, exported boolean, loc {LOC}, attrs {NODE_ATTRS}"
EDGES = f"idx long, src string, dst string, label string, src_label string, dst_label string, loc {LOC}, attrs {EDGE_ATTRS}"
BINDINGS = "file string, local string, source_file string, symbol_name string, kind string"
REGISTRY = "file string, method string, has_xmethod boolean, param_count int"
FILES = (
    "ord long, path string, lines int, imports array<struct<name:string,alias:string,source:string,isDefault:boolean,isDynamic:boolean,isNamespace:boolean>>,"
    "exports array<struct<name:string,type:string,source:string>>,"
    "functions array<struct<name:string,isExported:boolean,isAsync:boolean,isArrow:boolean,paramCount:int,lines:int,complexity:int,calls:int,loc:struct<start:int,end:int>>>,"
    "classes array<struct<name:string,isExported:boolean,extends:string,methods:array<string>>>, calls array<string>, error string"
)
#: Edges between files that count as dependencies.
DEPENDENCIES = ("IMPORT", "DYNAMIC_IMPORT", "REEXPORT")

# Default parameters.
PAGERANK = {"alpha": 0.85, "max_iter": 100, "tol": 1e-6}
HITS = {"max_iter": 100, "tol": 1e-6}
LOUVAIN_PASSES = 50
BOTTLENECK_SIGMAS = 2.0
HOT_PATHS = 3
PROCESS = {"threshold": 0.4, "max_depth": 10}
IMPACT_DEPTH = 3
ADVICE = {"functions": 10, "exports": 8, "ratio": 5, "calls": 20, "fan_out": 8, "fan_in": 8, "coupling_degree": 9, "modularity": 0.3}
