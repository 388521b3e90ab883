"""Fixed values of the header checks: framework signs, hardening signs, texts."""

from __future__ import annotations

from codewarden.functions.matching import java_regex as _j

FRAMEWORKS = {
    "express": _j(r"""require\s*\(\s*['"]express['"]\s*\)|from\s+['"]express['"]"""),
    "fastapi": _j(r"from\s+fastapi\s+import|import\s+fastapi"),
    "flask": _j(r"from\s+flask\s+import|import\s+flask"),
    "django": _j(r"from\s+django|import\s+django"),
}
HELMET = _j(r"""require\s*\(\s*['"]helmet['"]\s*\)|from\s+['"]helmet['"]""")
WILDCARD_CORS = _j(r"""cors\(\s*\)|origin:\s*['"]?\*['"]?|Access-Control-Allow-Origin.*\*""")
CORS_ANCHORS = (("cors(", "origin:", "Access-Control-Allow-Origin"),)
SESSION_FORM = _j(r"<form\b", ignore_case=True)
# Literals of which a text with a session sign holds one (in lower case); only a form needs the pattern.
SESSION_WORDS = (
    "set_cookie response.cookies request.cookies session[ flask_login render_template app.secret_key session_cookie "
    "express-session cookie-session req.session"
).split()
# Each of them holds one of these.
SESSION_STEMS = "cookie session flask_login render_template app.secret_key".split()
FORM = "<form"
CSRF_WORDS = ("csrf", "csurf")
FLASK_APP = _j(r"\bFlask\s*\(")
FASTAPI_APP = _j(r"\bFastAPI\s*\(")
SECURITY_HEADERS = _j(
    r"Talisman|flask_talisman|Strict-Transport-Security|Content-Security-Policy|"
    r"X-Frame-Options|X-Content-Type-Options",
    ignore_case=True,
)
# Literals (in lower case) of which a text that matches holds one.
SECURITY_WORDS = "talisman strict-transport-security content-security-policy x-frame-options x-content-type-options"
FASTAPI_SECURITY = _j(
    r"add_middleware|HTTPSRedirectMiddleware|TrustedHostMiddleware|"
    r"import\s+secure|from\s+secure|Strict-Transport-Security|Content-Security-Policy",
    ignore_case=True,
)
FASTAPI_WORDS = "add_middleware httpsredirectmiddleware trustedhostmiddleware secure strict-transport-security content-security-policy"
DJANGO_SETTINGS = _j(r"^\s*INSTALLED_APPS\s*=", multiline=True)
DJANGO_CONTRIB = _j(r"""['"]django\.(?:contrib|middleware)""")
DJANGO_HARDENED = _j(r"SECURE_SSL_REDIRECT|SECURE_HSTS_SECONDS")

HASH_COMMENT_SUFFIXES = (".py", ".rb", ".sh", ".bash", ".yml", ".yaml", ".tf")

# check: (title, severity, phase, description, fix)
TEXTS = {
    "django": (
        "Django settings missing HTTPS/HSTS hardening",
        "MEDIUM",
        1,
        "This Django settings module sets neither SECURE_SSL_REDIRECT nor "
        "SECURE_HSTS_SECONDS, so it doesn't force HTTPS or send HSTS. "
        "`manage.py check --deploy` flags this.",
        "In your production settings add: SECURE_SSL_REDIRECT=True, "
        "SECURE_HSTS_SECONDS=31536000, SESSION_COOKIE_SECURE=True, "
        "CSRF_COOKIE_SECURE=True, SECURE_CONTENT_TYPE_NOSNIFF=True.",
    ),
    "helmet": (
        "Express app without Helmet security headers",
        "MEDIUM",
        1,
        "Express app without Helmet. Missing security headers "
        "(X-Frame-Options, HSTS, CSP, etc.) make your app vulnerable to "
        "clickjacking, XSS, and MIME-sniffing attacks.",
        "Install and use Helmet: `npm install helmet` then `app.use(helmet())`.",
    ),
    "flask": (
        "Flask app without security headers",
        "MEDIUM",
        1,
        "Flask sets no security headers on its own and no Flask-Talisman "
        "(or manual HSTS/CSP/X-Frame-Options) was found. That leaves the app "
        "open to clickjacking, protocol downgrade, and MIME-sniffing.",
        "Add Flask-Talisman: `pip install flask-talisman`, then `Talisman(app)` — "
        "or set the headers yourself in an `after_request` handler.",
    ),
    "fastapi": (
        "FastAPI app without security middleware",
        "LOW",
        1,
        "FastAPI adds no security headers by default and no security middleware "
        "(HSTS/CSP/frame-options, or the `secure` library) was found.",
        "Add security headers via middleware — e.g. `app.add_middleware(...)` for "
        "HTTPS redirect / trusted-host, or the `secure` library for HSTS/CSP/nosniff.",
    ),
    "cors": (
        "Wildcard CORS — any website can call your API",
        "MEDIUM",
        2,
        "CORS set to allow all origins (*). Any website can make requests "
        "to your API, potentially stealing user data via the browser.",
        "Restrict CORS to specific trusted origins instead of '*'.",
    ),
    "csrf": (
        "No CSRF protection detected",
        "MEDIUM",
        2,
        "No CSRF protection detected in a web app with form handling. "
        "Attackers can trick users into submitting unwanted actions.",
        "Add CSRF middleware (csurf for Express, CSRFProtect for Flask/Django).",
    ),
}
HELMET_PLACEHOLDER = "No helmet() middleware found"
CSRF_PLACEHOLDER = "No CSRF middleware found"
