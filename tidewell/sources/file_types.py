"""Labels of file types by extension."""

#: Fixed values, which must be these for equal labels; an extension without one has none.
TYPE_LABELS = {
    ".adb": "Ada",
    ".adoc": "AsciiDoc",
    ".ads": "Ada",
    ".agda": "Agda",
    ".aidl": "AIDL",
    ".applescript": "AppleScript",
    ".as": "ActionScript",
    ".asciidoc": "AsciiDoc",
    ".asm": "Assembly",
    ".ass": "SubStation Alpha",
    ".astro": "Astro",
    ".bat": "Batch",
    ".bib": "BibTeX",
    ".c": "C",
    ".cabal": "Cabal",
    ".cc": "C++",
    ".cjs": "JavaScript",
    ".clj": "Clojure",
    ".cljc": "Clojure",
    ".cljs": "ClojureScript",
    ".cls": "LaTeX Class",
    ".cmd": "Batch",
    ".cob": "COBOL",
    ".coffee": "CoffeeScript",
    ".conf": "Config",
    ".cpp": "C++",
    ".cs": "C#",
    ".csh": "Shell",
    ".css": "CSS",
    ".csv": "CSV",
    ".cw": "Carmine Whitespace",
    ".d": "D",
    ".dart": "Dart",
    ".diff": "Diff",
    ".dockerfile": "Dockerfile",
    ".dts": "Device Tree",
    ".dtsi": "Device Tree",
    ".eex": "EEx",
    ".ejs": "EJS",
    ".el": "Emacs Lisp",
    ".elm": "Elm",
    ".env": "Env",
    ".erl": "Erlang",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".f": "Fortran",
    ".f03": "Fortran",
    ".f90": "Fortran",
    ".f95": "Fortran",
    ".fish": "Shell",
    ".fs": "F#",
    ".fsx": "F#",
    ".gitattributes": "Git Attributes",
    ".gitconfig": "Git Config",
    ".gitignore": "Gitignore",
    ".gql": "GraphQL",
    ".gradle": "Gradle",
    ".graphql": "GraphQL",
    ".groovy": "Groovy",
    ".gvy": "Groovy",
    ".h": "C Header",
    ".haml": "Haml",
    ".handlebars": "Handlebars",
    ".hbs": "Handlebars",
    ".heex": "HEEx",
    ".hjson": "HJSON",
    ".hpp": "C++ Header",
    ".hrl": "Erlang",
    ".hs": "Haskell",
    ".htm": "HTML",
    ".html": "HTML",
    ".ics": "iCalendar",
    ".ini": "INI",
    ".jade": "Pug",
    ".java": "Java",
    ".jl": "Julia",
    ".js": "JavaScript",
    ".json": "JSON",
    ".json5": "JSON5",
    ".jsonc": "JSONC",
    ".jsx": "JSX",
    ".ksh": "Shell",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".latex": "LaTeX",
    ".less": "Less",
    ".lhs": "Literate Haskell",
    ".liquid": "Liquid",
    ".lisp": "Lisp",
    ".log": "Log",
    ".lpr": "Lazarus",
    ".lrc": "Lyrics",
    ".lua": "Lua",
    ".m": "Objective-C",
    ".make": "Makefile",
    ".markdown": "Markdown",
    ".md": "Markdown",
    ".mdx": "MDX",
    ".meta": "Meta",
    ".mjs": "JavaScript",
    ".mk": "Makefile",
    ".ml": "OCaml",
    ".mli": "OCaml",
    ".mm": "Objective-C++",
    ".mustache": "Mustache",
    ".nim": "Nim",
    ".ninja": "Ninja",
    ".njk": "Nunjucks",
    ".org": "Org Mode",
    ".pas": "Pascal",
    ".patch": "Patch",
    ".php": "PHP",
    ".pl": "Perl",
    ".plist": "Property List",
    ".pm": "Perl",
    ".pod": "POD",
    ".pp": "Pascal",
    ".properties": "Properties",
    ".proto": "Protobuf",
    ".ps1": "PowerShell",
    ".psm1": "PowerShell",
    ".pug": "Pug",
    ".purs": "PureScript",
    ".py": "Python",
    ".pyi": "Python",
    ".r": "R",
    ".rake": "Rake",
    ".rb": "Ruby",
    ".rej": "Reject",
    ".res": "ReScript",
    ".resi": "ReScript",
    ".rmd": "R Markdown",
    ".rs": "Rust",
    ".rst": "reStructuredText",
    ".s": "Assembly",
    ".sass": "Sass",
    ".scala": "Scala",
    ".scm": "Scheme",
    ".scss": "SCSS",
    ".sh": "Shell",
    ".slim": "Slim",
    ".sql": "SQL",
    ".srt": "SubRip",
    ".ssa": "SubStation Alpha",
    ".sty": "LaTeX Style",
    ".styl": "Stylus",
    ".stylus": "Stylus",
    ".sub": "Subtitles",
    ".sv": "SystemVerilog",
    ".svelte": "Svelte",
    ".svg": "SVG",
    ".swift": "Swift",
    ".tcl": "Tcl",
    ".tex": "LaTeX",
    ".text": "Text",
    ".textile": "Textile",
    ".thrift": "Thrift",
    ".tmux": "Tmux",
    ".toml": "TOML",
    ".ts": "TypeScript",
    ".tsv": "TSV",
    ".tsx": "TSX",
    ".twig": "Twig",
    ".txt": "Text",
    ".v": "Verilog",
    ".vala": "Vala",
    ".vb": "Visual Basic",
    ".vcard": "vCard",
    ".vcf": "vCard",
    ".vhd": "VHDL",
    ".vhdl": "VHDL",
    ".vim": "Vim Script",
    ".vtt": "WebVTT",
    ".vue": "Vue",
    ".wast": "WebAssembly Text",
    ".wat": "WebAssembly Text",
    ".xml": "XML",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".zig": "Zig",
    ".zsh": "Shell",
}
