"""Fixed values of the JavaScript and Python taint checks: sources, sinks, word lists."""

from __future__ import annotations

from codewarden.functions.matching import java_regex as _j
from codewarden.rules.injection import CONST_STR

# JavaScript ------------------------------------------------------------------------------------
JS_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
CODE_SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")

JS_SOURCE = _j(
    r"""\b(?:req|request|ctx)\.(?:body|query|params|headers|cookies|url|originalUrl|baseUrl|path|querystring)\b"""
    r"""|(?:\bwindow\.)?\blocation\.(?:hash|search|href|pathname)\b"""
    r"""|\bdocument\.(?:URL|documentURI|referrer|cookie)\b"""
    r"""|\bprocess\.(?:argv|env)\b|\bwindow\.name\b"""
)
JS_SOURCE_ANCHORS = (("req", "ctx", "location.", "document.", "process.", "window.name"),)

# One definition per line: destructuring, else declaration, else (re)assignment.
JS_DEFINITION = _j(
    r"""^\s*(?:"""
    r"""(?:const|let|var)\s*[{\[]\s*([^}\]]*)[}\]]\s*=\s*(\S.*)"""
    r"""|(?:const|let|var)\s+([A-Za-z_$][\w$]*)(?:\s*:\s*[^=\n]+?)?\s*=\s*(\S.*)"""
    r"""|([A-Za-z_$][\w$]*)\s*\+?=(?!=)\s*(\S.*)"""
    r""")$"""
)
JS_IDENT = _j(r"""(?<![\w$.])[A-Za-z_$][\w$]*""")
JS_OBJECT_KEY = _j(r"""[\w$]+\s*:""")
JS_CONST_RHS = _j(r"""^(?:""" + CONST_STR + r"""|\d+(?:\.\d+)?|true|false|null|undefined)\s*;?\s*$""")
JS_KEYWORDS = (
    "await new typeof void delete this true false null undefined function return if else for while do switch "
    "case break continue in of instanceof let const var async yield class extends super import export default "
    "document window console Math JSON String Number Boolean Array Object RegExp Date Promise require module"
).split()

JS_NOSQL_SINK = _j(
    r"""\.(?:find|findOne(?:And\w+)?|deleteOne|deleteMany|updateOne|updateMany)\s*\("""
    r"""(?!\s*(?:function\b|\([^)\n]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>))([^)\n]*)"""
)
JS_QUERY_IDENT_SINK = _j(r"""\.(?:query|execute)\s*\(\s*([A-Za-z_$][\w$]*)\s*[,)]""")
JS_EXEC_IDENT_SINK = _j(r"""(?<![\w.])exec(?:Sync)?\s*\(\s*([A-Za-z_$][\w$]*)\s*[,)]""")
_ARG = r"""((?:[^,()\n]++|\([^)\n]*+\))++)"""
JS_PATH_SINK = _j(
    r"""\.(?:readFile|readFileSync|createReadStream|createWriteStream|writeFile|writeFileSync|appendFile|appendFileSync"""
    r"""|unlink|unlinkSync|stat|statSync|lstat|lstatSync|access|accessSync|exists|existsSync|open|openSync"""
    r"""|readdir|readdirSync|realpath|realpathSync|copyFile|copyFileSync|rename|renameSync|rmdir|rmdirSync|mkdir|truncate"""
    r"""|sendFile|download)"""
    r"""\s*\(\s*""" + _ARG
)
JS_SSRF_SINK = _j(
    r"""(?<![\w.$])(?:fetch|axios|got|superagent)\s*\(\s*"""
    + _ARG
    + r"""|\b(?:axios|http|https|got|request|superagent|fetch)"""
    r"""\.(?:get|post|put|patch|del|delete|head|request)\s*\(\s*""" + _ARG
)
JS_DESERIALIZE_SINK = _j(r"""\bunserialize\s*\(\s*([^,)\n]+)""")
JS_REDIRECT_SINK = _j(r"""(?<![\w.])(?:res|response|reply|ctx)\s*\.\s*redirect\s*\(\s*([^)\n]+)""")

# Python ----------------------------------------------------------------------------------------
PY_SOURCE_ROOT = "request"
PY_SOURCE_ATTRIBUTES = ("sys.argv", "os.environ")
PY_SOURCE_CALLS = ("os.getenv", "input")
PY_SQL_SINKS = ("execute", "executemany", "query", "raw")
PY_SUBPROCESS_NAMES = ("run", "call", "Popen", "check_call", "check_output")
PY_PATH_SINKS = ("open", "send_file", "send_from_directory")
PY_SSRF_METHODS = ("get", "post", "put", "delete", "patch", "head", "request", "urlopen")
PY_SSRF_RECEIVERS = ("requests", "httpx", "urllib", "session", "aiohttp", "urlopen")
PY_DESERIALIZE_METHODS = ("loads", "load")
PY_DESERIALIZE_RECEIVERS = ("pickle", "cPickle", "_pickle", "marshal", "dill", "shelve")
PY_REDIRECT_NAMES = ("redirect", "HttpResponseRedirect", "RedirectResponse")
