"""Public suffixes that no rule gives: names under which anyone may register, or is given a site of their own.

Fixed values, in the notation of public suffix rules: ``*.x`` stands for every name right below x, ``!x`` excepts one of
those. Second-level labels of countries (co.uk, com.au) follow by rule; see ``url_filter.SECOND_LEVELS``.
"""

from __future__ import annotations

#: Of registries.
REGISTRIES = (
    "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kitakyushu.jp", "!city.kitakyushu.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp",
    "*.sapporo.jp", "!city.sapporo.jp", "*.sendai.jp", "!city.sendai.jp", "*.yokohama.jp", "!city.yokohama.jp", "ad.jp", "ed.jp", "gr.jp", "lg.jp", "asn.au", "id.au", "police.uk", "nhs.uk", "gen.nz", "geek.nz", "iwi.nz", "kiwi.nz", "maori.nz", "school.nz",
    "firm.in", "gen.in", "ind.in", "nic.in", "res.in", "adv.br", "art.br", "blog.br", "eco.br", "eng.br", "ind.br", "jus.br", "leg.br", "k12.il", "muni.il", "law.za", "web.za", "idf.il", "asso.fr", "gouv.fr", "tm.fr", "web.id", "sch.id", "idv.tw", "idv.hk",
    "in.th", "mi.th", "biz.tr", "bel.tr", "gen.tr", "web.tr", "info.pl", "waw.pl", "priv.no", "in.ua", "kiev.ua", "msk.ru", "spb.ru",
)

#: Of hosts that give their users names below their own.
HOSTS = (
    "github.io", "githubusercontent.com", "gitlab.io", "bitbucket.io", "readthedocs.io", "blogspot.com", "appspot.com", "web.app", "firebaseapp.com", "run.app", "withgoogle.com", "cloudfront.net", "s3.amazonaws.com", "*.compute.amazonaws.com",
    "*.elb.amazonaws.com", "elasticbeanstalk.com", "awsapprunner.com", "amplifyapp.com", "azurewebsites.net", "azurestaticapps.net", "blob.core.windows.net", "cloudapp.net", "trafficmanager.net", "herokuapp.com", "netlify.app", "vercel.app", "now.sh", "pages.dev", "workers.dev",
    "fly.dev", "onrender.com", "up.railway.app", "deno.dev", "surge.sh", "glitch.me", "repl.co", "replit.app", "neocities.org", "wordpress.com", "wpengine.com", "wixsite.com", "weebly.com", "webflow.io", "squarespace.com", "myshopify.com", "tumblr.com",
    "substack.com", "medium.com", "livejournal.com", "typepad.com", "ghost.io", "hatenablog.com", "blog.jp", "altervista.org", "000webhostapp.com", "infinityfreeapp.com", "x10.mx", "dyndns.org", "duckdns.org", "no-ip.org", "ngrok.io", "ngrok-free.app",
    "translate.goog", "notion.site", "carrd.co", "itch.io", "gitbook.io", "streamlit.app", "hf.space", "pythonanywhere.com", "fandom.com", "eu.org", "uk.com", "us.com", "de.com", "eu.com", "gb.net", "co.com", "co.nl",
)

SUFFIXES = (*REGISTRIES, *HOSTS)
