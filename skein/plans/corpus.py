"""Templates of code, sessions, rules and manifests, and how a supplier is put into them.

The code-shaped queries work on a corpus that is derived from the table of suppliers: every supplier has a module of its
own, whose files, names, rules, sessions and manifests bear its key.
"""

CODE_COLUMNS = "path string, ext string, status string, content string"
CODE = [
    ("src/auth.py", "py", "unstaged", "import jwt\n\n\ndef authenticate_user(name, password):\n    # TODO: rotate keys\n    token = make_token(name)\n    return token\n\n\ndef make_token(name):\n    return jwt.encode(name)\n"),
    ("src/main.py", "py", "tracked", "from auth import authenticate_user\n\n\ndef main():\n    # We decided to use tokens\n    user = authenticate_user('a', 'b')\n    print(user)\n    save_user(user)\n\n\nif __name__ == '__main__':\n    main()\n"),
    ("src/db/models.py", "py", "tracked", "class User(Base):\n    id: int\n    email: str\n    active: bool\n\n\nclass Order(Base):\n    id: int\n    user_id: int\n\n\ndef save_user(user):\n    session.commit()\n"),
    ("src/api/routes.py", "py", "staged", "@app.get('/users')\ndef list_users():\n    return query_users()\n\n\n@app.post('/users')\ndef create_user(body):\n    validate_body(body)\n    return save_user(body)\n\n\ndef validate_body(body):\n    raise ValueError('constraint: must not be empty')\n"),
    ("src/app/api/users/[id]/route.ts", "ts", "tracked", "export async function GET(request) {\n  return fetchUser(request)\n}\n\nexport function fetchUser(request) {\n  return fetch('/db')\n}\n"),
    ("src/server.ts", "ts", "tracked", "const app = express()\napp.get('/health', healthCheck)\napp.delete('/users/:id', removeUser)\nfunction healthCheck(req) { return 1 }\n// FIXME: limit the rate\nconst removeUser = (req) => send_email(req)\n"),
    ("tests/test_auth.py", "py", "tracked", "from auth import authenticate_user\n\n\ndef test_login():\n    assert authenticate_user('a', 'b')\n    assert make_token('a')\n"),
    ("Dockerfile", "", "tracked", "FROM python:3.12\nRUN pip install flask\nCOPY . /app\nCMD python main.py\n"),
    ("deploy/compose.yaml", "yaml", "tracked", "services:\n  web:\n    image: web\n"),
    ("src/lib.rs", "rs", "tracked", "pub struct Index { n: u32 }\n\nimpl Index {\n}\n\npub fn build_index(n: u32) -> Index {\n    // BUG: overflow\n    Index { n }\n}\n\nfn main() {\n    build_index(3);\n}\n"),
]

SYMBOL_COLUMNS = "path string, name string, kind string, line int"
SYMBOLS = [
    ("src/auth.py", "authenticate_user", "function", 4), ("src/auth.py", "make_token", "function", 10), ("src/main.py", "main", "function", 4),
    ("src/db/models.py", "User", "class", 1), ("src/db/models.py", "Order", "class", 7), ("src/db/models.py", "save_user", "function", 12),
    ("src/api/routes.py", "list_users", "function", 2), ("src/api/routes.py", "create_user", "function", 7), ("src/api/routes.py", "validate_body", "function", 12),
    ("src/app/api/users/[id]/route.ts", "fetchUser", "function", 5), ("src/server.ts", "healthCheck", "function", 4), ("src/lib.rs", "build_index", "function", 6), ("src/lib.rs", "Index", "struct", 1),
]

CONVENTION_COLUMNS = "id string, name string, description string, category string, priority string, scope array<string>, pattern string"
CONVENTIONS = [
    ("conv:1", "no-print", "Use logging", "convention:style", "required", ["context:backend"], r"\bprint\("),
    ("conv:2", "no-todo", "Close notes", "convention:process", "optional", ["context:backend", "context:api"], r"\bTODO\b"),
    ("conv:3", "typed-models", "Type fields", "convention:style", "recommended", ["context:data"], r"class \w+\(Base\)"),
    ("conv:4", "ascii-names", "Plain names", "convention:naming", "recommended", ["context:frontend"], r"[^\x00-\x7F]+"),
    ("conv:5", "license", "State a license", "convention:legal", "required", ["context:infra"], r"(?i)\blicen[cs]ed?\b"),
    ("conv:6", "no-mail", "No addresses", "convention:security", "required", ["context:auth"], r"[a-z0-9]+@[a-z0-9.]+"),
]

EVENT_COLUMNS = "session string, ord int, ts double, kind string, tool_use_id string, name string, path string, score double"
EVENTS = [
    ("s1", 1, 0.0, "user", None, None, None, None), ("s1", 2, 1.0, "tool_use", "t1", "search", None, 0.4), ("s1", 3, 2.0, "tool_result", "t1", None, None, None),
    ("s1", 4, 20.0, "tool_use", "t2", "Read", "src/auth.py", None), ("s1", 5, 21.0, "tool_result", "t2", None, None, None), ("s1", 6, 50.0, "tool_use", "t3", "Edit", "src/auth.py", None),
    ("s1", 7, 100.0, "tool_use", "t4", "Read", "src/main.py", None), ("s1", 8, 130.0, "user", None, None, None, None), ("s2", 1, 5.0, "tool_use", "u1", "search", None, 0.9),
    ("s2", 2, 8.0, "tool_use", "u2", "Read", "src/lib.rs", None), ("s2", 3, 9.0, "tool_result", "u2", None, None, None), ("s2", 4, 70.0, "user", None, None, None, None),
    ("s3", 1, 0.0, "tool_use", "v1", "search", None, 0.1), ("s3", 2, 59.0, "tool_use", "v2", "Read", "src/server.ts", None), ("s3", 3, 60.5, "tool_use", "v3", "Read", "src/lib.rs", None), ("s3", 4, 61.0, "user", None, None, None, None),
]

MANIFEST_COLUMNS = "name string, spec string, ord int"
MANIFEST = [("react", "^18.0.0", 1), ("express", "~4.18", 2), ("react", "^17.0.0", 3), ("zod", "*", 4), ("pytest", ">=8", 5)]
LOCK_COLUMNS = "name string, locked string"
LOCK = [("react", "18.2.0"), ("express", "4.18.2"), ("unused", "1.0.0")]
REGISTRY_COLUMNS = "name string, kind string"
REGISTRY = [("react", "framework"), ("express", "framework"), ("pytest", "testing")]
SIGNAL_COLUMNS = "service string, weight double, source string"
SIGNALS = [("payments", 0.9, "package.json"), ("payments", 0.6, "src/pay.ts"), ("payments", 0.4, "src/cart.ts"), ("mail", 0.4, "src/mail.ts"), ("mail", 0.3, "src/x.ts"), ("storage", 0.3, "src/s.py"), ("storage", 0.3, "src/t.py"), ("cache", 0.2, "a"), ("cache", 0.2, "b"), ("cache", 0.2, "c"), ("cache", 0.2, "d")]

REGEX_COLUMNS = "pattern string"
REGEXES = [(r"(a+)+",), (r"(?:foo\s+)?bar",), (r"(a|a)*b",), (r".*x.*y",), (r"[a-z]+[0-9]+",), (r"\bword\b",), (r"(x*y)*",), (r"^\d{3}$",), (r"[^ ]* [a-z]+ [0-9]+",)]

IDENTIFIER_COLUMNS = "text string"
IDENTIFIERS = [("getUserById",), ("XMLHttpRequest",), ("snake_case_name",), ("kebab-case-name",), ("module.component.name",), ("HTTP2",), ("XHttp",), ("a_b_c_def",), ("über straße",), ("parse2JSON",), ("path/to/File.py",), ("ALLCAPS",), ("x",), ("C:\\dir\\FileName",)]

REMOTE_COLUMNS = "url string"
REMOTES = [("git@host.example:Owner/Repo.git",), ("https://host.example/owner/repo",), ("ssh://git@host.example:22/owner/repo.git",), ("https://user@host.example/Owner/Repo.git/",)]

# Changes that put a supplier's key into the templates, as SQL that both engines read.

#: Names of the code that bear the module's key, wherever they stand.
OWN_NAMES = ["authenticate_user", "make_token", "save_user", "list_users", "create_user", "validate_body", "fetchUser", "healthCheck", "build_index", "main(", "User(", "Order("]


def own(column: str) -> str:
    """A column with the module's key behind its own names."""
    for name in OWN_NAMES:
        stem, end = name.rstrip("("), "(" if name.endswith("(") else ""
        column = f"replace({column}, '{name}', concat('{stem}_', k, '{end}'))"
    return column


PATH = "concat('m', k, '/', path)"
CODE_OF = {"path": PATH, "content": own("content")}
SYMBOL_OF = {"path": PATH, "name": f"case when name in ('main', 'User', 'Order') then concat(name, '_', k) else {own('name')} end"}
CONVENTION_OF = {"id": "concat(id, '@', k)", "name": "concat(name, '-', k)"}
EVENT_OF = {"session": "concat(session, '-', k)", "tool_use_id": "case when tool_use_id is null then null else concat(tool_use_id, '-', k) end"}
NAME_OF = {"name": "concat(name, '-', k)"}
SERVICE_OF = {"service": "concat(service, '-', k)"}
REGEX_OF = {"pattern": "concat(pattern, k)"}
IDENTIFIER_OF = {"text": "concat(text, k)"}
REMOTE_OF = {"url": "replace(replace(url, 'Owner', concat('Owner', k)), 'owner', concat('owner', k))"}
PATH_OF = {"path": PATH}
