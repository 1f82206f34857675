"""Column functions over paths, ids and names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# What file names say.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript", ".d.ts": "TypeScript", ".d.mts": "TypeScript", ".d.cts": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".pyi": "Python", ".json": "JSON", ".jsonc": "JSON", ".json5": "JSON", ".md": "Markdown", ".markdown": "Markdown", ".mdx": "Markdown", ".css": "CSS", ".scss": "CSS", ".sass": "CSS", ".less": "CSS", ".html": "HTML", ".htm": "HTML",
    ".yaml": "YAML", ".yml": "YAML", ".svg": "SVG", ".xml": "XML", ".toml": "TOML", ".ini": "INI", ".cfg": "INI", ".conf": "INI", ".txt": "Text", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell", ".ps1": "PowerShell",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".scala": "Scala", ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".cxx": "C++", ".hpp": "C++", ".hh": "C++", ".hxx": "C++",
    ".m": "Objective-C", ".mm": "Objective-C++", ".sql": "SQL", ".graphql": "GraphQL", ".gql": "GraphQL", ".proto": "Protobuf", ".vue": "Vue", ".svelte": "Svelte", ".astro": "Astro",
}
NO_CODE = frozenset("JSON Markdown CSS HTML YAML SVG XML TOML INI Text".split())
IMAGES = ".png .jpg .jpeg .gif .bmp .ico .webp .tif .tiff .avif .heic .heif".split()
FONTS = ".woff .woff2 .ttf .otf .eot".split()
MEDIA = ".mp3 .mp4 .wav .ogg .oga .webm .mov .avi .mkv .flac .m4a .aac .m4v .wmv".split()
ARCHIVES = ".zip .tar .gz .tgz .tar.gz .bz2 .tar.bz2 .xz .tar.xz .7z .rar .jar .war".split()
OTHER_BINARY = ".pdf .wasm .so .dylib .dll .exe .bin .class .o .a .node .dat .dmg .iso".split()
BINARY = (*IMAGES, *FONTS, *MEDIA, *ARCHIVES, *OTHER_BINARY)
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json bun.lockb".split()
CONFIG_NAMES = (
    "package.json tsconfig.json jsconfig.json tsconfig.base.json tsconfig.build.json .eslintrc .eslintrc.js .eslintrc.cjs .eslintrc.json .eslintrc.yaml .eslintrc.yml eslint.config.js eslint.config.mjs eslint.config.cjs "
    ".prettierrc .prettierrc.json .prettierrc.js .prettierrc.cjs .prettierrc.yaml .prettierrc.yml prettier.config.js prettier.config.cjs babel.config.js babel.config.json .babelrc .babelrc.js .babelrc.json "
    "vite.config.js vite.config.ts vite.config.mjs vitest.config.js vitest.config.ts vitest.config.mjs webpack.config.js rollup.config.js rollup.config.mjs jest.config.js jest.config.ts jest.config.cjs "
    ".editorconfig .nvmrc .node-version .gitignore .gitattributes .dockerignore .npmignore .kgignore dockerfile docker-compose.yml docker-compose.yaml makefile quarry.config.json"
).split()
CONFIG_EXTENSIONS = ".yaml .yml .toml .ini .cfg .conf .editorconfig".split()
COMPOUND = ".d.ts .d.mts .d.cts .tar.gz .tar.bz2 .tar.xz".split()
SKIPPED_DIRS = ".git .kg-cache node_modules .cache .turbo .vite dist build coverage .next .venv venv __pycache__ .pytest_cache .mypy_cache".split()
SECRET_NAMES = "id_rsa id_dsa id_ecdsa id_ed25519 .npmrc .netrc _netrc".split()
SECRET_SUFFIXES = ".key .key.pem -key.pem .private.pem .p12 .pfx .jks .keystore .pkcs12 .ppk .p8 .mobileprovision .provisionprofile".split()
ENTRY_STEMS = "index main bootstrap entry app server cli worker setup".split()
BUILD_DIRS = "dist build out lib es esm cjs".split()
GENERATED_DIRS = "dist build out .next coverage storybook-static __generated__".split()


def norm_posix(p: Column) -> Column:
    """Backslashes turned, trailing slashes off, the empty path is `.`."""
    cut = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/+$", "")
    return F.when(cut == "", ".").otherwise(cut)


def base_name(p: Column) -> Column:
    return F.element_at(F.split(norm_posix(p), "/"), -1)


def dir_name(p: Column) -> Column:
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def extension(name: Column) -> Column:
    """The last suffix with its dot, in lower case, compound ones as one; empty for a name without a dot or that only begins with one."""
    low = F.lower(name)
    compound = F.regexp_extract(low, "^.+(" + "|".join(c.replace(".", r"\.") for c in COMPOUND) + ")$", 1)
    return F.when(compound != "", compound).otherwise(F.regexp_extract(low, r"^.+(\.[^.]*)$", 1))


def classify(path: Column) -> Column:
    """A struct of extension, language, kind (lockfile, asset, test, doc, config, else code, in this order), trust, isBinary, isGenerated."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    base = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), path))
    ext = extension(base)
    known = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())]), ext)
    binary = ext.isin(*BINARY)
    language_ = F.coalesce(known, F.when(binary, "Binary").when((base == "dockerfile") | base.startswith("dockerfile."), "Dockerfile").when(base == "makefile", "Makefile").otherwise("Unknown"))
    asset = binary | (ext == ".svg")
    coded = known.isNotNull() & ~language_.isin(*NO_CODE)
    under = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.isin("tests", "__tests__"))
    doc = language_ == "Markdown"
    lock = base.isin(*LOCKFILES)
    kind_ = (
        F.when(lock, "lockfile").when(asset, "asset").when(base.rlike(r"\.(test|spec)\.") | (under & coded), "test").when(doc, "doc")
        .when(base.isin(*CONFIG_NAMES) | ext.isin(*CONFIG_EXTENSIONS), "config").otherwise("code")
    )
    return F.struct(
        ext.alias("extension"), language_.alias("language"), kind_.alias("kind"), F.when(doc, "doc").when(asset, "asset").otherwise("code").alias("trust"), binary.alias("isBinary"), (lock | base.contains(".min.") | (ext == ".map")).alias("isGenerated")
    )


def language(path: Column) -> Column:
    return classify(path)["language"]


def kind(path: Column) -> Column:
    return classify(path)["kind"]


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", ""))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(__tests__|__test__|tests?|spec)/") | path.rlike(r"(?i)\.(test|spec)\.[a-z]+$")


def is_linkable(path: Column) -> Column:
    """Whether imports can lead there, by the last suffix."""
    return F.substring_index(path, "/", -1).rlike(r"(?i)^.+\.([mc]?[jt]s|[jt]sx)$")


def is_entry_like(path: Column) -> Column:
    """Scripts at the top, ambient declarations, tool settings, and names of entry points: nothing need import them."""
    name = F.substring_index(path, "/", -1)
    return (F.instr(path, "/") == 0) | name.rlike(r"(?i)\.d\.[cm]?ts$") | name.rlike(r"(?i)\.config\.") | stem(path).isin(*ENTRY_STEMS)


def should_skip(path: Column, is_dir: Column | None = None) -> Column:
    """The rules before ignore files, of a path and of all folders above it: skipped folders, system files, credentials, dotenv files but samples."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def named(s: Column) -> Column:
        low = F.lower(s)
        dotenv = ((s == ".env") | s.startswith(".env.")) & ~(low.endswith(".sample") | low.endswith(".example"))
        return (s == ".DS_Store") | s.isin(*SECRET_NAMES) | low.rlike("(" + "|".join(x.replace(".", r"\.") for x in SECRET_SUFFIXES) + ")$") | dotenv

    folder = lambda s: s.isin(*SKIPPED_DIRS) | s.endswith(".egg-info")
    last = F.element_at(parts, -1)
    return F.exists(above, folder) | F.exists(parts, named) | (F.coalesce(is_dir, F.lit(False)) & folder(last) if is_dir is not None else F.lit(False))


def kebab(s: Column) -> Column:
    """FooBar and foo_bar to foo-bar; nothing left is `unassigned`."""
    cut = F.regexp_replace(F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2")
    dashed = F.regexp_replace(F.regexp_replace(F.lower(cut), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "unassigned").otherwise(dashed)


def is_relative(spec: Column) -> Column:
    return spec.rlike(r"^\.\.?(/|$)")


def package_name(spec: Column) -> Column:
    """Scope and name of an npm specifier, or the name alone."""
    scoped = F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1)
    return F.when(spec.startswith("@") & (scoped != ""), scoped).otherwise(F.substring_index(spec, "/", 1))


def package_scope(name: Column) -> Column:
    return F.when(name.startswith("@") & (F.instr(name, "/") > 0), F.substring_index(name, "/", 1))


def resolve_path(base: Column, spec: Column) -> Column:
    """A path from a folder, with `.` and `..` folded."""
    parts = F.split(F.concat_ws("/", base, spec), "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def base_symbol_id(s: Column) -> Column:
    """Without the ordinal of a repeated name."""
    return F.regexp_replace(s, r"~\d+$", "")


def symbol_path(s: Column) -> Column:
    """What stands before the last # of a symbol's id."""
    return F.regexp_extract(s, r"^sym:(.*)#[^#]*$", 1)


def short_symbol(s: Column) -> Column:
    return F.regexp_replace(s, r"^sym:(.*)#([^#]*)$", "$2@$1")


def symbol_ref(ref: Column) -> Column:
    """A struct of path (null without one) and name."""
    bare = F.regexp_replace(ref, "^sym:", "")
    has = F.instr(bare, "#") > 0
    return F.struct(F.when(has, F.regexp_extract(bare, "^(.*)#[^#]*$", 1)).alias("path"), F.when(has, F.regexp_extract(bare, "#([^#]*)$", 1)).otherwise(bare).alias("name"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    return F.ceil(F.length(F.encode(text, "UTF-16BE")) / 2 / 4).cast("long")


def slug(s: Column) -> Column:
    """A name that file systems take: letters, digits, _, . and -; nothing left is `domain`."""
    cut = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(cut == "", "domain").otherwise(cut)


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def more_marker(hidden: Column) -> Column:
    return F.when(hidden > 0, F.concat(F.lit("(+"), hidden.cast("string"), F.lit(" more…)"))).otherwise("")


def dir_prefixes(path: Column) -> Column:
    """All folders above a path, each with its slash, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))


def fragment(text: Column, most: int) -> Column:
    """White space flattened, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def slice_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from one; what lies beyond the end is left out."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


def first_doc_line(raw: Column, most: int = 100) -> Column:
    """First line of a comment that is not empty once its marks are off, cut with an ellipsis."""
    bare = F.filter(F.transform(F.split(raw, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*(/\*+|\*+/|\*+|//+)?", ""), r"\*+/\s*$", ""))), lambda s: s != "")
    return fragment(F.coalesce(F.get(bare, F.lit(0)), F.lit("")), most)


def revision_of(snapshot: Column) -> Column:
    """What stands after the last colon; no revision is null."""
    tail = F.substring_index(snapshot, ":", -1)
    return F.when(tail.isin("", "no-revision", "unknown"), F.lit(None)).otherwise(tail)


def is_importable(path: Column) -> Column:
    """Whether an import can be of this file: a source, not generated, no declaration file, no test."""
    made = F.exists(F.split(path, "/"), lambda s: s.isin(*GENERATED_DIRS))
    return ~made & ~path.rlike(r"\.d\.(ts|mts|cts)$") & ~path.rlike(r"(^|/)__tests__/") & ~path.rlike(r"\.(test|spec)\.[a-z]+$") & path.rlike(r"\.([mc]?[jt]s|[jt]sx)$")


def injects_globals(path: Column, text: Column) -> Column:
    """Whether a file can change what files that do not import it mean. A null text is a deleted file, told by its path alone."""
    return path.endswith(".d.ts") | F.coalesce(text.rlike(r"\bdeclare\s+global\b|\bexport\s+as\s+namespace\b"), F.lit(False))


def generated_label(model: Column, provider: Column, generated_at: Column) -> Column:
    return F.concat_ws("", F.lit("generated by "), model, F.lit(" via "), provider, F.concat(F.lit(", "), F.substring(generated_at, 1, 10)))


def caveat(n: Column, files: Column) -> Column:
    """A sentence on computed imports, singular or plural; empty for none."""
    s = F.concat(n.cast("string"), F.when(n == 1, " computed import").otherwise(" computed imports"), F.lit(" in "), files.cast("string"), F.when(files == 1, " file").otherwise(" files"), F.lit(" may hide uses"))
    return F.when(n > 0, s).otherwise("")


def without_build_extension(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"(?i)\.(?:d\.(?:ts|mts|cts)|ts|tsx|mts|cts|js|jsx|mjs|cjs)$", "")


def under_dir(path: Column, folder: Column) -> Column:
    return (folder == ".") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def source_variants(target: Column, package_dir: Column | None = None) -> Column:
    """A built file's path and where its source may be: the build folder replaced by src, or left out, both without the built extension.

    Folders of the package's own path are no build folders.
    """
    parts = F.split(target, "/")
    skipped = F.when(package_dir == ".", 0).otherwise(F.size(F.filter(F.split(package_dir, "/"), lambda s: s != ""))) if package_dir is not None else F.lit(0)
    built = F.array_position(F.transform(parts, lambda s, k: (k >= skipped) & s.isin(*BUILD_DIRS)), True).cast("int")
    before, after = F.slice(parts, F.lit(1), F.greatest(built - 1, F.lit(0))), F.slice(parts, built + 1, F.size(parts))
    inner = F.concat(F.slice(after, F.lit(1), F.greatest(F.size(after) - 1, F.lit(0))), F.array(F.regexp_replace(F.element_at(parts, -1), r"(?i)\.(?:d\.(?:ts|mts|cts)|ts|tsx|mts|cts|js|jsx|mjs|cjs)$", "")))
    made = F.array_distinct(F.array(target, F.array_join(F.concat(before, F.array(F.lit("src")), inner), "/"), F.array_join(F.concat(before, inner), "/")))
    return F.when((built == 0) | (built == F.size(parts)), F.array(target)).otherwise(made)
