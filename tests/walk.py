"""Reading a project's build files one after the other: a plain version of the include tree and what hangs on it."""

import re

BUILD_FILE = "CMakeLists.txt"
REF = re.compile(r"\$\{([A-Za-z0-9_]+)\}")


def arg_text(a):
    return re.sub(r"(?s)\\(.?)", r"\1", a[1:-1]) if len(a) >= 2 and a[0] == a[-1] == '"' else a


def single(text):
    m = re.fullmatch(r"\s*\$\{([A-Za-z0-9_]+)\}\s*", text)
    return m and m[1]


def join(folder, path):
    parts = folder.split("/") if folder else []
    if path.startswith("/"):
        return None
    for x in path.split("/"):
        if x == "..":
            if not parts:
                return None
            parts.pop()
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts)


class Project:
    """scripts: {path: [(command, args)]}, variables: {name: [values]}, paths: every file."""

    def __init__(self, scripts, variables, paths):
        self.scripts, self.variables, self.paths = scripts, variables, set(paths) | set(scripts)
        self.edges, self.defines, self.targets, self.selections, self.conditional, self.defaults = [], [], [], [], [], {}
        self.context((), "", {}, {}, [""])

    def build(self, folder):
        return f"{folder}/{BUILD_FILE}" if folder else BUILD_FILE

    def context(self, tags, top, lists, composed, tops):
        if self.build(top) not in self.paths:
            return
        own = {"tags": tags, "visited": set(), "defines": [], "lists": lists, "composed": composed, "tops": tops}
        self.file(own, top)
        for d in own["defines"]:
            refs = self.known(composed.get(d["var"], "")) if d["kind"] == "bare" else []
            if len(refs) >= 2:
                d.update(kind="composed", var=None, template=self.fill(composed[d["var"]]), source=refs)
        self.defines += [(tags, d["define"], d["kind"], d["var"], d["template"], d["gate"], ",".join(d["source"])) for d in own["defines"]]

    def known(self, text):
        return [v for v in REF.findall(text) if v in self.variables]

    def fill(self, text):
        return REF.sub(lambda m: "{" + m[1] + "}" if m[1] in self.variables else m[0], text)

    def file(self, own, folder, parent=None):
        if folder in own["visited"] or self.build(folder) not in self.paths:
            return
        own["visited"].add(folder)
        if parent is not None:
            self.edges.append((own["tags"], parent, folder, None))
        gates = []
        for command, args in self.scripts.get(self.build(folder), []):
            if command in ("if", "elseif"):
                gate = self.gate(args)
                if command == "if":
                    gates.append(gate)
                elif gates:
                    gates[-1] = gate
            elif command == "endif":
                if gates:
                    gates.pop()
            else:
                gate = next((g for g in reversed(gates) if g), None)
                getattr(self, command, lambda *a: None)(own, folder, args, gate)

    def gate(self, args):
        if not args:
            return None
        name = single(arg_text(args[0])) or arg_text(args[0])
        if name not in self.variables:
            return None
        return (name, arg_text(args[2])) if len(args) >= 3 and arg_text(args[1]) == "STREQUAL" else (name, None)

    def seen(self, folder, path):
        joined = join(folder, path)
        return path if not folder or joined is None else joined

    def add_subdirectory(self, own, folder, args, gate):
        if not args:
            return
        text = arg_text(args[0])
        var = single(text)
        if var in self.variables:
            for value in self.variables[var]:
                child = join(folder, value)
                if child is None or self.build(child) not in self.paths or child in own["tops"]:
                    continue
                tags = (*own["tags"], (var, value))
                self.edges.append((tags, folder, child, (var, value)))
                self.context(tags, child, dict(own["lists"]), dict(own["composed"]), [*own["tops"], child])
            return
        child = join(folder, text)
        if child is not None:
            self.file(own, child, folder)

    def set(self, own, folder, args, gate):
        if not args:
            return
        name, rest = arg_text(args[0]), [arg_text(a) for a in args[1:]]
        if name in self.variables and "CACHE" in [name, *rest]:
            if not own["tags"]:
                self.defaults[name] = (rest[0] or None) if rest else None
        elif name in ("CMAKE_C_FLAGS", "CMAKE_CXX_FLAGS"):
            for token in rest[0].split() if rest else []:
                if token.startswith("-D") and "=" in token:
                    define, value = token[2:].split("=", 1)
                    var = single(value)
                    if var in self.variables:
                        self.put(own, define, "bare", var)
                    elif var:
                        if len(self.known(own["composed"].get(var, ""))) >= 2:
                            self.put(own, define, "composed", None, own["composed"][var])
                    elif len(self.known(value)) >= 2:
                        self.put(own, define, "composed", None, value)
        elif name.endswith("_SOURCES"):
            own["lists"][name] = [self.seen(folder, x) for x in rest]
        elif rest and self.known(rest[0]):
            own["composed"][name] = rest[0]

    def put(self, own, define, kind, var, text=None, gate=None):
        source = [gate[0]] if gate else [var] if var else self.known(text)
        own["defines"].append({"define": define.strip() if not gate else define, "kind": kind, "var": var, "template": self.fill(text) if text else None, "gate": gate, "source": source})

    def option(self, own, folder, args, gate):
        if args and arg_text(args[0]) in self.variables and not own["tags"]:
            word = arg_text(args[2]) if len(args) > 2 else ""
            self.defaults[arg_text(args[0])] = "true" if word in ("ON", "TRUE", "YES", "1") else "false" if word in ("OFF", "FALSE", "NO", "0") else None

    def add_compile_definitions(self, own, folder, args, gate):
        for a in args:
            body = arg_text(a).removeprefix("-D")
            if "=" not in body:
                continue
            define, value = body.split("=", 1)
            value = value.strip()
            inner = single(value[1:-1]) if len(value) >= 2 and value[0] == value[-1] == '"' else None
            if inner in self.variables:
                self.put(own, define, "quoted", inner)
            elif single(value) in self.variables:
                self.put(own, define, "bare", single(value))
            elif len(self.known(value)) >= 2:
                self.put(own, define, "composed", None, value)

    def add_definitions(self, own, folder, args, gate):
        for a in args:
            body = arg_text(a).removeprefix("-D")
            if "=" not in body:
                if gate:
                    self.put(own, body, "gated", None, gate=gate)
            elif single(body.split("=", 1)[1].strip()) in self.variables:
                self.put(own, body.split("=", 1)[0], "bare", single(body.split("=", 1)[1].strip()))

    def target_compile_definitions(self, own, folder, args, gate):
        for a in args[1:] if gate else []:
            text = arg_text(a)
            if text in ("PRIVATE", "PUBLIC", "INTERFACE") or "=" in text:
                continue
            if not any(d["kind"] == "gated" and d["define"] == text and d["gate"] == gate for d in own["defines"]):
                self.put(own, text, "gated", None, gate=gate)

    def add_library(self, own, folder, args, gate, kind="lib"):
        if not args:
            return
        target, sources, driving = arg_text(args[0]), [], None
        for a in args[1:]:
            text = arg_text(a)
            if text in ("STATIC", "SHARED", "MODULE", "INTERFACE", "OBJECT", "EXCLUDE_FROM_ALL"):
                continue
            if single(text) in own["lists"]:
                listed = own["lists"][single(text)]
                sources += listed
                driving = next((v for p in reversed(listed) for v in reversed(self.known(p))), driving)
            else:
                sources.append(self.seen(folder, text))
        self.targets += [(own["tags"], target, kind, p) for p in [p for p in sources if "${" not in p] or [None]]
        if driving:
            mark = "${" + driving + "}"
            before, _, after = next(p for p in sources if mark in p).partition(mark)
            found = [(p[len(before) : len(p) - len(after)], p) for p in self.paths if p.startswith(before) and p.endswith(after) and len(p) > len(before) + len(after)]
            found = [(v, p) for v, p in found if re.fullmatch("[A-Za-z0-9_]+", v)]
            self.selections += [(own["tags"], target, driving, v, p) for v, p in found]
            if found:
                return
        there = [p for p in sources if p in self.paths]
        if gate and there:
            self.conditional.append((own["tags"], target, kind, *gate, ",".join(there)))

    def add_executable(self, own, folder, args, gate):
        self.add_library(own, folder, args, gate, "exe")
