"""What the lines of source files declare: one table of rules for each language.

A rule is (kind, relation, pattern). Its first group is the name that the line declares or refers to; a second group,
where the relation is inherits or implements, is the list of bases of the name in the first group.
"""

from __future__ import annotations

Rule = tuple[str, str, str]

IDENT = r"[A-Za-z_$][\w$]*"
_PY: list[Rule] = [
    ("class", "contains", rf"^class\s+({IDENT})"),
    ("class", "inherits", rf"^class\s+({IDENT})\s*\(([^)]*)\)"),
    ("method", "method", rf"^\s+(?:async\s+)?def\s+({IDENT})"),
    ("function", "contains", rf"^(?:async\s+)?def\s+({IDENT})"),
    ("module", "imports", r"^\s*import\s+([\w.]+)"),
    ("module", "imports_from", r"^\s*from\s+([\w.]+)\s+import\b"),
]
_JS: list[Rule] = [
    ("class", "contains", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({IDENT})"),
    ("class", "inherits", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({IDENT})\s+extends\s+([\w$.]+)"),
    ("function", "contains", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({IDENT})"),
    ("function", "contains", rf"^\s*(?:export\s+)?const\s+({IDENT})\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    ("module", "imports_from", r"""^\s*import\b.*?from\s*['"]([^'"]+)['"]"""),
    ("module", "imports_from", r"""^\s*import\s*['"]([^'"]+)['"]"""),
    ("module", "imports", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("module", "imports", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("module", "re_exports", r"""^\s*export\b.*?from\s*['"]([^'"]+)['"]"""),
]
_TS: list[Rule] = [
    *_JS,
    ("interface", "contains", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+({IDENT})"),
    ("interface", "inherits", rf"^\s*(?:export\s+)?interface\s+({IDENT})\s+extends\s+([\w$,.\s]+)"),
    ("class", "implements", rf"^\s*(?:export\s+)?(?:abstract\s+)?class\s+({IDENT})[^{{]*\bimplements\s+([\w$,.\s]+)"),
    ("type", "contains", rf"^\s*(?:export\s+)?type\s+({IDENT})\s*(?:<[^=]*>)?\s*="),
    ("enum", "contains", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+({IDENT})"),
]
_CURLY_TYPE = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|partial|override|export)\s+)*"
_JVM: list[Rule] = [
    ("class", "contains", rf"{_CURLY_TYPE}(?:class|record|object|trait)\s+({IDENT})"),
    ("interface", "contains", rf"{_CURLY_TYPE}(?:interface|@interface)\s+({IDENT})"),
    ("enum", "contains", rf"{_CURLY_TYPE}enum\s+(?:class\s+)?({IDENT})"),
    ("class", "inherits", rf"{_CURLY_TYPE}class\s+({IDENT})[^{{]*?\bextends\s+([\w$.]+)"),
    ("class", "implements", rf"{_CURLY_TYPE}class\s+({IDENT})[^{{]*?\bimplements\s+([\w$,.\s]+)"),
    ("module", "imports", r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
]
_COLON_BASES: list[Rule] = [
    ("class", "contains", rf"{_CURLY_TYPE}(?:class|struct|protocol|interface|record)\s+({IDENT})"),
    ("class", "inherits", rf"{_CURLY_TYPE}(?:class|struct|protocol|interface|record)\s+({IDENT})[^{{:]*:\s*([\w.,\s]+)"),
    ("enum", "contains", rf"{_CURLY_TYPE}enum\s+({IDENT})"),
]
_C: list[Rule] = [
    ("function", "contains", rf"^[A-Za-z_][\w\s*&:<>,~]*?[\s*&]({IDENT})\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$"),
    ("struct", "contains", rf"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+({IDENT})"),
    ("module", "imports", r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]"""),
]
_RAKE: list[Rule] = [
    ("class", "contains", r"^\s*class\s+([A-Z][\w:]*)"),
    ("class", "inherits", r"^\s*class\s+([A-Z][\w:]*)\s*<\s*([A-Z][\w:]*)"),
    ("module", "contains", r"^\s*module\s+([A-Z][\w:]*)"),
    ("method", "method", r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!=]?)"),
    ("module", "imports", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""),
]
_MARKUP_SCRIPT: list[Rule] = [*_JS, ("component", "contains", r"<([A-Z][\w.]*)")]

RULES: dict[str, list[Rule]] = {
    "python": _PY,
    "javascript": _JS,
    "typescript": _TS,
    "java": [*_JVM, ("method", "method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+[\w<>\[\],.\s]+?\s+({IDENT})\s*\(")],
    "kotlin": [*_JVM, *_COLON_BASES[1:2], ("function", "method", rf"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?({IDENT})")],
    "scala": [*_JVM, ("class", "inherits", rf"^\s*(?:case\s+)?(?:class|object|trait)\s+({IDENT})[^{{]*?\bextends\s+([\w.]+)"), ("function", "method", rf"^\s*(?:\w+\s+)*def\s+({IDENT})")],
    "groovy": [*_JVM, ("method", "method", rf"^\s*(?:def|void|static\s+\w+)\s+({IDENT})\s*\(")],
    "csharp": [*_COLON_BASES, ("module", "imports", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"), ("namespace", "contains", r"^\s*namespace\s+([\w.]+)"), ("method", "method", rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+[\w<>\[\],.?\s]+?\s+({IDENT})\s*\(")],
    "swift": [*_COLON_BASES, ("extension", "contains", rf"^\s*extension\s+({IDENT})"), ("function", "method", rf"^\s*(?:\w+\s+)*func\s+({IDENT})"), ("module", "imports", r"^\s*import\s+([\w.]+)")],
    "rust": [("struct", "contains", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union|trait)\s+({IDENT})"), ("struct", "implements", rf"^\s*impl(?:<[^>]*>)?\s+({IDENT})(?:<[^>]*>)?\s+for\s+({IDENT})"), ("function", "contains", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+({IDENT})"), ("module", "imports", r"^\s*(?:pub\s+)?use\s+([\w:]+)"), ("module", "contains", rf"^\s*(?:pub\s+)?mod\s+({IDENT})")],
    "go": [("struct", "contains", rf"^type\s+({IDENT})\s+(?:struct|interface)\b"), ("function", "contains", rf"^func\s+({IDENT})\s*[\[(]"), ("method", "method", rf"^func\s+\([^)]*\)\s*({IDENT})"), ("module", "imports", r"""^(?:import)?\s*(?:[\w.]+\s+)?"([\w./-]+)"\s*$""")],
    "c": _C,
    "cpp": [*_C, *_COLON_BASES[:1], ("class", "inherits", rf"^\s*(?:class|struct)\s+({IDENT})\s*(?:final\s*)?:\s*((?:public|private|protected|virtual|[\w:<>,\s])+)"), ("namespace", "contains", rf"^\s*namespace\s+({IDENT})"), ("method", "method", rf"^[\w\s*&:<>,~]+?::(~?{IDENT})\s*\(")],
    "objc": [("class", "contains", rf"^\s*@(?:interface|protocol|implementation)\s+({IDENT})"), ("class", "inherits", rf"^\s*@interface\s+({IDENT})\s*:\s*({IDENT})"), ("method", "method", rf"^\s*[-+]\s*\([^)]*\)\s*({IDENT})"), ("module", "imports", r"""^\s*#\s*import\s*[<"]([^>"]+)[>"]""")],
    "ruby": _RAKE,
    "php": [("class", "contains", rf"{_CURLY_TYPE}(?:class|interface|trait|enum)\s+({IDENT})"), ("class", "inherits", rf"{_CURLY_TYPE}class\s+({IDENT})[^{{]*?\bextends\s+([\w\\]+)"), ("class", "implements", rf"{_CURLY_TYPE}class\s+({IDENT})[^{{]*?\bimplements\s+([\w\\,\s]+)"), ("function", "method", rf"^\s*(?:\w+\s+)*function\s+&?({IDENT})"), ("module", "imports", r"^use\s+([\w\\]+)"), ("trait", "mixes_in", r"^\s+use\s+([\w\\]+)\s*;")],
    "lua": [("function", "contains", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("module", "imports", r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""")],
    "zig": [("function", "contains", rf"^\s*(?:pub\s+)?(?:export\s+)?fn\s+({IDENT})"), ("struct", "contains", rf"^\s*(?:pub\s+)?const\s+({IDENT})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)"), ("module", "imports", r"""@import\(\s*"([^"]+)"\s*\)""")],
    "haskell": [("module", "imports", r"^import\s+(?:qualified\s+)?([\w.]+)"), ("class", "contains", r"^(?:data|newtype|class|type)\s+(?:\([^)]*\)\s*=>\s*)?([A-Z]\w*)"), ("function", "contains", r"^([a-z_]\w*'*)\s*::")],
    "dart": [*_JVM[:1], *_JVM[3:5], ("method", "method", rf"^\s+(?:static\s+|async\s+)*[\w<>?]+\s+({IDENT})\s*\([^;]*\)\s*(?:async\s*)?\{{"), ("module", "imports", r"""^\s*import\s+['"]([^'"]+)['"]""")],
    "julia": [("function", "contains", r"^\s*function\s+([\w.!]+)"), ("struct", "contains", r"^\s*(?:mutable\s+)?struct\s+(\w+)"), ("struct", "inherits", r"^\s*(?:mutable\s+)?struct\s+(\w+)(?:\{[^}]*\})?\s*<:\s*(\w+)"), ("module", "imports", r"^\s*(?:using|import)\s+([\w.]+)"), ("module", "contains", r"^\s*module\s+(\w+)")],
    "elixir": [("module", "contains", r"^\s*defmodule\s+([\w.]+)"), ("function", "contains", r"^\s*(?:def|defp|defmacro)\s+([a-z_]\w*[?!]?)"), ("module", "imports", r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)")],
    "bash": [("function", "contains", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?"), ("module", "imports_from", r"^\s*(?:source|\.)\s+([^\s;]+)")],
    "powershell": [("function", "contains", r"(?i)^\s*function\s+([\w-]+)"), ("class", "contains", r"(?i)^\s*class\s+(\w+)"), ("module", "imports", r"(?i)^\s*(?:Import-Module|using\s+module)\s+([\w./\\-]+)")],
    "fortran": [("module", "contains", r"(?i)^\s*module\s+(?!procedure)(\w+)"), ("function", "contains", r"(?i)^\s*(?:\w+\s+)*(?:subroutine|function)\s+(\w+)"), ("module", "imports", r"(?i)^\s*use\s*(?:,\s*\w+\s*::)?\s*(\w+)")],
    "pascal": [("module", "contains", r"(?i)^\s*(?:unit|program|library)\s+([\w.]+)"), ("function", "contains", r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+([\w.]+)"), ("class", "contains", r"(?i)^\s*(\w+)\s*=\s*(?:class|record|interface)"), ("module", "imports", r"(?i)^\s*uses\s+([\w.]+)")],
    "verilog": [("module", "contains", r"^\s*(?:module|interface|package)\s+(\w+)"), ("module", "imports_from", r"""^\s*(?:`include\s+"([^"]+)")"""), ("module", "instantiates", r"^\s*(?!module|interface|package|assign|always|begin|end|case|if|else|input|output|wire|reg|logic)(\w+)\s+(?:#\s*\([^)]*\)\s*)?\w+\s*\(\s*\.")],
    "sql": [("table", "contains", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)"), ("table", "references", r"(?i)\breferences\s+[`\"\[]?([\w.]+)")],
    "cmake": [("target", "contains", r"(?i)^\s*(?:add_executable|add_library|function|macro|project)\s*\(\s*([\w.:-]+)"), ("module", "imports", r"(?i)^\s*(?:include|find_package|add_subdirectory)\s*\(\s*([\w./:${}-]+)")],
    "racket": [("function", "contains", r"^\s*\(define\s+\(?([^\s()]+)"), ("module", "imports", r"^\s*\(require\s+\(?([^\s()]+)")],
    "markdown": [("heading", "contains", r"^#{1,6}\s+(.+?)\s*#*$"), ("link", "references", r"\[[^\]]*\]\(([^)\s]+)\)")],
    "vue": _MARKUP_SCRIPT,
    "svelte": _MARKUP_SCRIPT,
    "astro": _MARKUP_SCRIPT,
    "razor": [("module", "imports", r"^\s*@using\s+([\w.]+)"), ("class", "inherits", r"^\s*@(inherits)\s+([\w.<>]+)"), ("component", "calls", r"<([A-Z]\w*)"), ("method", "contains", rf"^\s*(?:(?:public|private|protected|async|static)\s+)+[\w<>\[\]?]+\s+({IDENT})\s*\(")],
    "csproj": [("package", "imports", r"""<PackageReference\s+Include="([^"]+)\""""), ("project", "imports", r"""<ProjectReference\s+Include="([^"]+)\""""), ("target", "contains", r"<TargetFramework>([^<]+)<")],
    "sln": [("project", "contains", r"""^Project\([^)]*\)\s*=\s*"([^"]+)\""""), ("project", "imports", r"""^Project\([^)]*\)\s*=\s*"[^"]+"\s*,\s*"([^"]+)\"""")],
    "json_package": [("package", "depends_on", r"""^\s*"(@?[\w./-]+)"\s*:\s*"[\^~><=*]?\d[^"]*"\s*,?\s*$""")],
    "mcp_config": [("server", "contains", r"""^\s{2,4}"([\w.-]+)"\s*:\s*\{\s*$"""), ("command", "requires", r"""^\s*"command"\s*:\s*"([^"]+)\"""")],
    "dm": [("type", "contains", r"^(/[\w/]+)\s*$"), ("method", "method", r"^\s*(?:proc/|verb/)(\w+)\s*\("), ("module", "imports", r"""^\s*#include\s+"([^"]+)\""""), ("type", "instantiates", r"\bnew\s*(/[\w/]+)")],
}

#: Language by file ending; whole names go first.
ENDINGS: dict[str, str] = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ejs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".ets": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".groovy": "groovy", ".gradle": "groovy", ".cs": "csharp", ".swift": "swift", ".rs": "rust", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".m": "objc", ".mm": "objc",
    ".rb": "ruby", ".php": "php", ".lua": "lua", ".luau": "lua", ".toc": "lua", ".zig": "zig", ".hs": "haskell", ".dart": "dart", ".jl": "julia", ".ex": "elixir", ".exs": "elixir", ".sh": "bash", ".bash": "bash", ".ps1": "powershell",
    ".f": "fortran", ".f90": "fortran", ".f95": "fortran", ".f03": "fortran", ".f08": "fortran", ".pas": "pascal", ".pp": "pascal", ".dpr": "pascal", ".dpk": "pascal", ".lpr": "pascal", ".inc": "pascal", ".v": "verilog", ".sv": "verilog", ".svh": "verilog",
    ".sql": "sql", ".cmake": "cmake", ".rkt": "racket", ".md": "markdown", ".mdx": "markdown", ".qmd": "markdown", ".vue": "vue", ".svelte": "svelte", ".astro": "astro", ".razor": "razor", ".cshtml": "razor", ".csproj": "csproj", ".fsproj": "csproj",
    ".vbproj": "csproj", ".sln": "sln", ".dm": "dm", ".dme": "dm", ".dmm": "dm", ".dmf": "dm", ".dmi": "dm",
}
NAMES: dict[str, str] = {"package.json": "json_package", "mcp.json": "mcp_config", ".mcp.json": "mcp_config", "CMakeLists.txt": "cmake"}
