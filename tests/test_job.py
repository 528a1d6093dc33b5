"""The job over HTTP on this machine: landing, two runs, the reader's view."""

from __future__ import annotations

import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riffle import domain
from riffle.operators.store import Store, read_logos
from riffle.plans import digest, job

EXAMPLES = Path(__file__).resolve().parent.parent / "examples"
RSS = """<?xml version="1.0"?><rss><channel>
<item><title>Orbit Fleet gets patch notes</title><link>https://e.org/1</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate><description>Multiplayer works again. Enjoy.</description></item>
<item><title>Sponsored: a chair</title><link>https://e.org/2</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate><description>multiplayer video game</description></item>
<item><title>Badland Saga adds multiplayer</title><link>https://e.org/3</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate><description>x</description></item>
</channel></rss>"""
STEAM = '{"appnews": {"appid": 10, "newsitems": [{"title": "Small fix", "url": "https://s.org/1", "contents": "<b>fix</b> done", "date": 1704880800}]}}'
ATOM = '<feed><entry><title>heard a thing</title><link href="https://r.org/1"/><updated>2024-01-10T09:00:00Z</updated><content type="html">&lt;p&gt;so&lt;/p&gt;</content></entry></feed>'


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/rss": RSS, "/steam": STEAM, "/reddit": ATOM}.get(self.path.split("?")[0])
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_job(spark, server, tmp_path):
    config = job.Config.load(*(str(EXAMPLES / f"{n}.yaml") for n in ("sources", "rules", "pack")))
    media = (domain.Feed("Daily Orbit", f"{server}/rss", "en"), domain.Feed("Gone", f"{server}/gone", "en"))
    config = job.Config(domain.Sources(media, config.sources.steam, config.sources.subreddits, config.sources.limits, config.sources.title_patterns, config.sources.url_patterns), config.rules, config.pack)
    folder = f"{tmp_path}/landing"
    feeds = job.plan_feeds(config.sources, folder, job.Addresses(f"{server}/steam?{{app_id}}{{count}}", f"{server}/reddit?{{name}}"))
    status = {r.url.rsplit("/", 1)[1].split("?")[0]: r.status for r in job.land(spark, feeds, folder).collect()}
    assert status == {"rss": 200, "gone": 404, "steam": 200, "reddit": 200}
    store, now, lost = Store(spark, f"{tmp_path}/store"), F.lit(datetime(2024, 1, 10, 12)).cast("timestamp"), []
    for _ in range(2):
        rows, funnel = job.run(spark, config, [x for _, x in feeds], store, now, on_error=lambda f, e: lost.append(f.source))
        got = sorted((r.title, r.game, r.source_type) for r in rows.collect())
        assert got == [("Orbit Fleet gets patch notes", "Orbit Fleet", "media"), ("Small fix", "Orbit Fleet", "steam"), ("heard a thing", "Reddit Rumors", "reddit")]
    assert set(lost) == {"Gone"}
    assert [r.title for r in digest.read(store, section="rumors").where("source_type = 'reddit'").collect()] == ["heard a thing"]
    assert {r.name: r.logo for r in read_logos(spark, f"{store.base}/games").collect()} == {"Orbit Fleet": "logos/orbit-fleet.png", "Velvet Sun": None}
    assert read_logos(spark, f"{store.base}/none").count() == 0
    assert config.pack.collisions() == {}
