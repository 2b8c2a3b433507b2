"""Lines with planted secrets, made by other means than the ones that the field is trained on: formats of real tools and services, real words."""

import base64
import inspect
import json
import random
import string
import textwrap

ALNUM = string.ascii_letters + string.digits
PROSE = (
    "Please rotate the credentials before Friday, otherwise the nightly build is going to fail again. We moved the staging cluster to another region last week and "
    "nobody updated the runbook. The customer asked whether version 4.2.1 supports single sign-on; see ticket OPS-2381 for details. Mail me at maria.lopez@mail.example.org "
    "or call +44 20 7946 0018 between 09:00 and 17:30. Order 4031065727380220 shipped on 2024-03-18. Die Wörter stehen hier ohne Sinn, l'été est déjà fini."
).split()


def planted(n, seed, blind=False):
    """(text, [(start, stop)]) of the planted values; ``blind``: formats that were
    written after the field was finished, and measured once."""
    draw = random.Random(seed)
    pick = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))

    def jwt():
        head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
        body = base64.urlsafe_b64encode(json.dumps({"sub": pick(string.digits, 10), "name": draw.choice(PROSE), "iat": draw.randrange(10**9)}).encode()).decode().rstrip("=")
        return f"{head}.{body}.{pick(ALNUM + '-_', 43)}"

    def password():
        return draw.choice([
            lambda: draw.choice(["Tiger", "Winter", "dragon", "Berlin", "qwerty"]) + pick(string.digits, draw.randint(2, 4)) + draw.choice(["!", "$x", "#1", ""]),
            lambda: pick(ALNUM, draw.randint(9, 18)), lambda: pick(ALNUM, 5) + draw.choice("!#%&") + pick(ALNUM, 6),
        ])()

    formats = [
        lambda: ("github: ", "ghp_" + pick(ALNUM, 36), ""), lambda: ("GITLAB_PAT=", "glpat-" + pick(ALNUM + "-_", 20), ""), lambda: ("maps.init('", "AIza" + pick(ALNUM + "-_", 35), "')"),
        lambda: ("sendgrid ", "SG." + pick(ALNUM + "-_", 22) + "." + pick(ALNUM + "-_", 43), ""), lambda: ("curl -H 'Authorization: Bearer ", jwt(), "' https://api.example.org/v1/users"),
        lambda: ("//registry.npmjs.org/:_authToken=", "npm_" + pick(ALNUM, 36), ""), lambda: ("stripe.key('", "sk_live_" + pick(ALNUM, 24), "')"),
        lambda: ("slack: ", f"xoxb-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(ALNUM, 24)}", ""),
        lambda: ("aws_secret_access_key = ", pick(ALNUM + "/+", 40), ""), lambda: ("DATABASE_URL=postgres://app:", password(), "@db.internal:5432/orders"),
        lambda: ("mysql -u root --password=", password(), " orders"), lambda: ("  db_pwd: ", password(), ""), lambda: ("Server=sql01;User Id=sa;Pwd=", password(), ";"),
        lambda: ('{"clientSecret": "', pick(ALNUM + "~._-", 34), '"}'), lambda: ("AccountKey=", pick(ALNUM + "+/", 86) + "==", ";EndpointSuffix=core.example.net"),
        lambda: ("https.proxy: http://svc:", password(), "@proxy.example.com:3128"), lambda: ("<add key='smtpPassword' value='", password(), "'/>"),
        lambda: ("export SESSION_KEY='", pick(string.hexdigits[:16].upper(), 40), "'"), lambda: ("signing secret is ", pick(string.ascii_lowercase + string.digits, 32), "."),
        lambda: ("sshpass -p ", password(), " ssh deploy@10.0.0.7"),
    ]
    if blind:
        b64 = lambda n: base64.b64encode(pick(ALNUM, n).encode()).decode()
        formats = [
            lambda: ("define('DB_PASSWORD', '", password(), "');"), lambda: ("spring.datasource.password=", password(), ""), lambda: ("PGPASSWORD=", password(), " psql -h db -U app"),
            lambda: ("db.example.net:5432:shop:app:", password(), ""), lambda: ("Authorization: Basic ", b64(18), ""), lambda: ('"auths": {"registry.example.org": {"auth": "', b64(24), '"}}'),
            lambda: ("x-api-key: ", pick(ALNUM, 40), ""), lambda: ("shopify ", "shpat_" + pick(string.hexdigits[:16].lower(), 32), ""), lambda: ("DO_TOKEN dop_v1_", pick("0123456789abcdef", 64), ""),
            lambda: ("bot", pick(string.digits, 9) + ":" + pick(ALNUM + "-_", 35), "/sendMessage"), lambda: ("mailgun key-", pick(string.ascii_lowercase + string.digits, 32), ""),
            lambda: ("?sv=2022-11-02&sig=", pick(ALNUM + "+/", 43) + "=", "&se=2024"), lambda: ("requirepass ", password(), ""), lambda: ("IDENTIFIED BY '", password(), "';"),
            lambda: ("master_key: ", pick(string.hexdigits[:16].lower(), 32), ""), lambda: ("    token: ", jwt(), ""), lambda: ("LDAP_BIND_PW = '", password(), "'"), lambda: ("openssl enc -k ", password(), " -in a"),
        ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(draw.randint(1, 5)):
            if draw.random() < 0.4:
                before, value, after = draw.choice(formats)()
                text += before
                spans.append((len(text), len(text) + len(value)))
                text += value + after + draw.choice([" ", "\n"])
            at = draw.randrange(len(PROSE))
            text += " ".join(PROSE[at : at + draw.randint(3, 14)]) + draw.choice([" ", "\n"])
        out.append((text, spans))
    return out


def clean():
    """Texts of programs and their manuals, without secrets."""
    import argparse
    import email.message
    import getpass
    import http.cookies
    import netrc
    import urllib.request

    return [text for m in (argparse, email.message, getpass, http.cookies, json, netrc, textwrap, urllib.request, inspect) for text in inspect.getsource(m).split("\n\n\n")]
