"""What a path is: file type, generator name family."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import text as t

# Names that settle a file's type.
TEST_FOLDERS = ["test", "tests", "spec", "t"]
BUILD_NAMES = ["configure", "configure.ac", "configure.in", "cmakelists.txt", "meson.build", "setup.py", "setup.cfg", "pyproject.toml", "cargo.toml", "autogen.sh"]
BUILD_PREFIXES = ["makefile", "gnumakefile"]
BUILD_EXTENSIONS = [".mk", ".m4", ".cmake", ".gyp", ".pro"]
DOC_NAMES = ["news", "authors", "copying", "todo"]
DOC_PREFIXES = ["readme", "changelog"]
DOC_EXTENSIONS = [".md", ".rst", ".pod", ".adoc", ".texi", ".texinfo"]
DOC_FOLDERS = ["doc", "docs", "man", "documentation"]
CODE_EXTENSIONS = [".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".py", ".go", ".js", ".ts", ".rs", ".java", ".rb", ".pl", ".pm", ".php", ".sh", ".bash", ".lua", ".el", ".scala", ".swift", ".kt", ".cs", ".vala", ".ml"]
IGNORE_NAMES = [".gitignore", ".bzrignore", ".hgignore", ".cvsignore", ".svnignore"]
BENIGN_SUFFIXES, BENIGN_NAMES = [".po", ".pot"], ["changelog", "copyright"]

# Whole-line comment markers and block comment marks by extension.
HASH, SLASH, BLOCK = ["#"], ["//"], ("/*", "*/")
LINE_COMMENTS = {
    **dict.fromkeys([".py", ".sh", ".bash", ".pl", ".pm", ".rb", ".mk", ".toml", ".cfg", ".yaml", ".yml"], HASH),
    **dict.fromkeys([".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".js", ".ts", ".go", ".rs", ".java", ".scala", ".swift", ".kt", ".cs", ".vala"], SLASH),
    ".m4": ["dnl", "#"], ".php": ["//", "#"], ".lua": ["--"], ".el": [";"],
}
BLOCK_COMMENTS = {**dict.fromkeys([".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", ".js", ".ts", ".go", ".rs", ".java", ".php", ".scala", ".swift", ".kt", ".cs", ".vala"], BLOCK), ".ml": ("(*", "*)")}

# File names that generators write.
AUTOTOOLS = ["configure", "Makefile.in", "aclocal.m4", "libtool.m4", "ltoptions.m4", "ltsugar.m4", "ltversion.m4", "lt~obsolete.m4", "ltmain.sh", "ltconfig", "config.guess", "config.sub", "config.h.in", "missing", "install-sh", "mkinstalldirs", "depcomp", "compile", "ylwrap", "ar-lib", "py-compile", "test-driver", "mdate-sh", "texinfo.tex"]
NEEDS_BANNER = ["Makefile.in"]
TRANSLATIONS = {".po": "gettext", ".pot": "gettext", ".ts": "qt-linguist"}


def file_type(path: Column, ext: Column | None = None) -> Column:
    """test, build, doc, code or data; the first that fits."""
    base, ext, low = F.lower(t.basename(path)), t.extension(path) if ext is None else ext, F.lower(path)
    # A name above the last component; the pattern runs only where one is before a slash.
    inside = lambda names: t.any_of([low.contains(f"{n}/") for n in names]) & low.rlike(f"(?:^|/){t.either(names)}/+[^/]")
    return (
        F.when(inside(TEST_FOLDERS) | base.startswith("test_") | (ext == ".t") | (base.contains("_test") & base.rlike(r"_test(?:\.[^.]*)?$")), "test")
        .when(inside(["debian"]) | base.isin(BUILD_NAMES) | t.starts_with(base, BUILD_PREFIXES) | ext.isin(BUILD_EXTENSIONS), "build")
        .when(base.rlike(r"\.[1-9][a-z]*$") | ext.isin(DOC_EXTENSIONS) | inside(DOC_FOLDERS) | base.isin(DOC_NAMES) | t.starts_with(base, DOC_PREFIXES), "doc")
        .when(ext.isin(CODE_EXTENSIONS), "code")
        .otherwise("data")
    )


def _comment_kinds() -> dict[tuple, list[str]]:
    """Extensions by their (line markers, block marks)."""
    kinds: dict[tuple, list[str]] = {}
    for e in sorted({*LINE_COMMENTS, *BLOCK_COMMENTS}):
        kinds.setdefault((tuple(LINE_COMMENTS.get(e, [])), BLOCK_COMMENTS.get(e)), []).append(e)
    return kinds


#: Begin of a changed line of a section, trimmed or not, and white space inside a line.
CHANGED, SPACE = r"(?dmU)^(?:\+(?!\+\+ [^\n]*[^\s])|-(?!-- [^\n]*[^\s]))", r"[\s&&[^\n]]*+"


def only_comments(section: Column, ext: Column) -> Column:
    """Every changed line of a section is blank or a comment as a whole in the language of `ext`; false where its comments aren't known. The first line that is neither ends the search."""
    out = F.when(F.lit(False), F.lit(False))
    for (markers, block), extensions in _comment_kinds().items():
        forms = [re.escape(m) for m in markers] + ([re.escape(block[0]) + "[^\\n]*" + re.escape(block[1]) + SPACE + "$"] if block else [])
        out = out.when(ext.isin(extensions), ~section.rlike(CHANGED + SPACE + f"(?!$|{'|'.join(forms)})"))
    return out.otherwise(F.lit(False))


def only_patterns(section: Column, path: Column) -> Column:
    """The file is an ignore file, and every changed line of its section is blank, a comment or one word."""
    other = CHANGED + SPACE + r"(?!#)[^\s]++[\s&&[^\n]]++[^\s]"
    return F.when(F.lower(t.basename(path)).isin(IGNORE_NAMES), ~section.rlike(other)).otherwise(F.lit(False))


def name_family(path: Column) -> Column:
    return F.when(t.strip_backup(t.basename(path)).isin(AUTOTOOLS), "autotools")


def benign_data(path: Column) -> Column:
    return F.lower(path).rlike(r"\.pot?$") | F.lower(t.basename(path)).isin(BENIGN_NAMES)
