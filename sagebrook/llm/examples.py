"""Labelled examples of prose, lists, tables and junk.

``EXAMPLES`` are written ones, by family: (kind, texts).  ``INSPECTED`` are short documents of the test tables, picked from groups
of like statistics and labelled by reading them.  They are all the labelled rows there are: about 160, a bound that doesn't grow with
the collection.
"""

from __future__ import annotations

_THINGS = ["query log", "old cache entry", "ranking model", "Lumbarit parser", "slow index shard", "token counter", "user session", "Morvelin queue", "broken link check", "daily report", "merge step", "hidden field", "request handler", "storage tier", "page title", "Kastoret review"]
_ENGLISH = "The reader of this guide will find that the index is built once a day, and it is then used by all of the services until the next one has been written. We did not change how the pages are cut, because the old limits had been set with care."
_GERMAN = "Der Index wird in der Nacht gebaut und dann von allen Diensten benutzt, bis der nächste fertig ist. Das Team hat die Seiten nicht neu zerlegt, weil die alten Grenzen mit Sorgfalt gesetzt waren."
_FRENCH = "Le fichier est écrit dans la nuit et il est lu par tous les services avant la mise à jour. Ce n'est pas une copie mais une vue qui ne change plus après la première lecture."
_SPANISH = "El índice se escribe en la noche y es leído por todos los servicios hasta la próxima versión. No es una copia sino una vista que no cambia después de la primera lectura."
_JAPANESE = "夜のうちに索引を作り直します。そのため、朝には新しい一覧を使うことができます。古い記録はしばらく残しておきますが、あとで短くします。"
_WIDE = lambda cells: "".join(c.ljust(22) for c in cells)


def _rows(sep: str, start: str = "", end: str = "") -> str:
    head = ["name", "count", "share", "last seen"]
    rows = [head, *([t, str(17 * n + 3), f"0.{n + 11}", "n/a" if n % 4 else "yes"] for n, t in enumerate(_THINGS))]
    return "\n".join(start + sep.join(r) + end for r in rows)


def _wrapped(text: str) -> str:
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > 64:
            lines.append("")
        lines[-1] = (lines[-1] + " " + w).strip()
    return "\n".join(lines)


EXAMPLES: dict[str, tuple[str, list[str]]] = {
    "prose": ("prose", [_ENGLISH * 3, _GERMAN * 3, _FRENCH * 3, _SPANISH * 3, _ENGLISH + "\n\n" + _ENGLISH, "# A heading\n\n" + _ENGLISH * 2]),
    "wrapped prose": ("prose", [_wrapped(_ENGLISH * 3), _wrapped(_GERMAN * 3), _wrapped(_FRENCH * 3), "user: " + _ENGLISH + "\nassistant: " + _SPANISH]),
    "plain prose": ("prose", [(_ENGLISH * 3).lower().replace(".", "").replace(",", ""), (_FRENCH * 3).lower().replace(".", ""), (_ENGLISH * 2).upper()]),
    "japanese prose": ("prose", [_JAPANESE * 4, _JAPANESE + "\n\n" + _JAPANESE, "# 見出し\n" + _JAPANESE * 2]),
    "mixed prose": ("prose", [_ENGLISH * 4 + "\n\n- query log\n- user session\n- merge step\n\n" + _ENGLISH, _GERMAN * 4 + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n" + _GERMAN, _ENGLISH * 3 + "\n\n```\ndef run(x):\n    return x.step(3)\n```\n\n" + _ENGLISH]),
    "short prose": ("prose", [_ENGLISH.split(", and")[0] + ".", "We did not change how the pages are cut.", "Kastoret has moved its slow queue, so that the night is quiet."]),
    "marked list": ("list", ["\n".join("- " + t for t in _THINGS), "\n".join(f"{n + 1}. {t}" for n, t in enumerate(_THINGS)), "\n".join("* [ ] fix " + t + ";" for t in _THINGS)]),
    "plain list": ("list", ["\n".join(_THINGS), "\n".join(t.capitalize() for t in _THINGS), "\n".join(f"    {t}" for t in reversed(_THINGS))]),
    "gloss list": ("list", ["\n".join(f"{a}: {b}" for a, b in zip(_THINGS, _THINGS[3:])), "\n".join(f"{t} see {7 * n + 2}, {19 * n + 31}" for n, t in enumerate(_THINGS)), "\n".join(f"{t} pp. {n + 3}, {n * 11 + 14}" for n, t in enumerate(_THINGS))]),
    "path list": ("list", ["\n".join(f"{a}/{b}-{n}.md".replace(" ", "_") for n, (a, b) in enumerate(zip(_THINGS, _THINGS[2:])))]),
    "row list": ("list", [", ".join(_THINGS * 2), " / ".join(_THINGS * 2), "; ".join(_THINGS)]),
    "led list": ("list", ["We did not change how the pages are cut, but the list is new.\n" + "\n".join("- " + t for t in _THINGS), "The index is built once a day from all of these.\n" + "\n".join(_THINGS), "Das Team hat die Seiten nicht neu zerlegt.\n" + "\n".join(f"{n}) {t}" for n, t in enumerate(_THINGS))]),
    "marked table": ("table", [_rows(" | ", "| ", " |"), _rows("</td><td>", "<tr><td>", "</td></tr>"), "+------+------+\n" + _rows(" | ", "| ", " |") + "\n+------+------+"]),
    "value table": ("table", [_rows(","), _rows(";"), _rows("\t")]),
    "wide table": ("table", ["\n".join(_WIDE([t, str(31 * n), f"0.{n}", "no"]) for n, t in enumerate(_THINGS))]),
    "led table": ("table", [_ENGLISH[:150] + ".\n" + _rows(" | ", "| ", " |"), _GERMAN[:130] + ".\n" + _rows(";"), _ENGLISH[:120] + ".\n" + "\n".join(_WIDE([t, str(31 * n), f"0.{n}"]) for n, t in enumerate(_THINGS))]),
    "encoded": ("junk", ["aGVsbG8gd29ybGQgdGhpcyBpcyBub3RoaW5nIGJ1dCBhIHRlc3Q0Nzk2NDQ0NzIzOHF3ZXJ0eXVpb3A" * 5, "".join(f"{(n * 7919) % 65536:04x}" for n in range(110))]),
    "symbols": ("junk", ["~~##%%^^ ||>>{}{} &&** ---===... \\\\// <>#! @@~~ %%20 ^^~" * 6, "░▒▓█ ##~~ ***&#x {}{} %20%C3 |/|/| ==--" * 8]),
    "random words": ("junk", ["qzkvxw jhtrp wvxkq zzjqd pkxvt hgqwz xjk wqz kvjx bdfqz tkkwx zvq jxwqk rtzzk qpwjx vkz hjq xwzk qqj" * 3]),
    "broken": ("junk", [_GERMAN.replace("e", "�").replace("ä", "Ã¤") * 3, _FRENCH.replace("i", "�").replace("é", "Ã©") * 3]),
    "salad": ("junk", [" ".join(_THINGS * 3), " ".join(w for t in _THINGS[::-1] for w in t.split()[::-1]) * 3]),
    "crumbs": ("junk", ["Home > Shop > Help > Basket > Home > Login > Back > Help > Shop > Back > Print " * 5, "Home · Back · Login · Shop · Print · Help · Back · Basket · Login · Home · Shop " * 5, "Home » Print » Shop » Login » Help » Back » Basket » Home » Login » Help » Print"]),
    "repetition": ("junk", ["more more more more more more more more " * 12, "see here now see here now see here now " * 14, "bbbbbbb bbbbbbb bbbbbbb bbbbbbb " * 20]),
    "dump": ("junk", ["{" + ",".join(f'"{a.replace(" ", "_")}":{n * 37 % 11 or "null"}' for n, a in enumerate(_THINGS * 2)) + "}", "\n".join(f'{{"ts": {n * 1931}, "level": "info", "shard": {n}}}' for n in range(14))]),
    "log": ("junk", ["\n".join(f"2024-03-{n + 10}T08:{n + 11}:07 [info] pid={n * 37} shard={n} rc=0" for n in range(15)), "\n".join(f"{n * 16:08x}  6a 94 ce 17 93 72 d2 0d 49 e1 38 6d 22 f7 2a ab" for n in range(12))]),
}

#: (kind, text).
INSPECTED: list[tuple[str, str]] = [
    ("junk", 'schema draft chunk splitter cached reader thread hidden tiny public sentence boundary late byte offset nested manual glossary entry experimental agent loop agent loop message buffer sparse dense automatic'),
    ("junk", 'NQvrp8ayLBRU7qFqdfTelR47kXHWlPki6c1Z/kaKNXFXch6LMt2PzL/oukPnpVSnq82xRue0AhOY5V4SGCV58nuTpNlF8roxeGVB33cLZtjggbdPQPD+6VOVvMAkD1RlUiV8eTQPK+NzWjuT4GdLzkk2jf0TMh+SYZXMzAUUNpjBZxKKOnhJ6G/t4okg96NY0BvvVTkBU1Vxw3MO//nsEqsTldaCMCqqK7jQzkUxazWi0gqO9oNSoFZX64Da+MW+N1cRuCTZbzs9NZlU3SdHXqA7eiFwS7LFCsAYA+jG7s5HQZx00iDnWOqNglJm5zocG4CXM3gi23eDDWrVNrBxZz7uW5JrLK7w5TaHRkngSjc5FCv02UJXC/8vmzXkhtUxSWyI0kZPr6iPBvTA5tdwOZ4P8pdC77Po1'),
    ("junk", '...{} {}^^|/| ==%20 ^^ ****** ---░▒...##\\/***░▒%20~~--- |/||/|## ░▒==░▒%C3 |/|## \\/~~\\/{}▓█%20 %20*** ▓█...|/|%20...▓█---&nbsp;&nbsp;==░▒---\\/%C3 ^^\\/ &nbsp;... ***%20&#x^^|/|{}▓█\\/\\/==|/|░▒##~~~~ |/|...##&nbsp;%20---&#x%C3%20*** ░▒<><>▓█{}==%20##~~ ~~ %20***---&#x<>{}== '),
    ("junk", '2025-03-12T03:52:00 [info] pid=15268 cost_estimate=7 rc=2\n2025-08-12T02:14:00 [debug] pid=39 query_planner=156 rc=1\n2025-08-18T09:18:00 [warn] pid=4 distance_threshold=21454 rc=0\n2025-01-15T00:41:00 [warn] pid=13 schema_draft=3109 rc=2\n2025-01-18T06:12:00 [debug] pid=947 query_planner=3 rc=0\n2025-09-16T09:54:00 [info] pid=199 support_thread=6173 rc=1\n2025-05-17T09:43:00 [warn] pid=150 support_thread=25523 rc=2\n2025-02-18T09:19:00 [warn] pid=6176 neighbour_lookup=348 rc=1'),
    ("junk", 'buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy index now buy '),
    ("junk", 'lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lore'),
    ("junk", '0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0'),
    ("junk", 'Rf1R043ZI1z0BED2RME7f3ZaLXda2P+XMApjUny3Z5LxnxKwfKmDAaKaFSK+AoovuBM6JAUA33Es\ndsg3lzXJ9tDcp3/p+FRfSIc2GY8ykMMnDAr+8D03fPkKCTU+OKSI3I9K/BpvsQgrMXStbsswiGHX\npVBCQV0SRH7EoZbo9CZRjsFKUm+oVPlKdHT0Z7sIRGL3aLTUlzo+TvTmOIF4nLZzdAdZJGy+WFBX\nup4vsMHcAws3rVUL4ohmOEdIXzZ+sGLvKSQwI/nOWDpvNt9pNGoFInR3pZkeDEFcBaUdSpPSQZBa\nIWHMYJw8lH7F8'),
    ("junk", 'Print > Next > Register > Docs > Previous > Login > Menu > Login > Menu > Previous > Contact > Contact > Contact > Register > Cart > Home > Docs > Docs > Home > Home > Login > Menu > Previous > Share > Login > Previous > Docs > Previous > Previous > Home > Login > Cart > Register > Print > Contact > Next'),
    ("junk", 'aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaaaa aaaaaa'),
    ("junk", '00000000  8f 13 97 8a 70 9d 5e e3 fe 60 2d e0 13 39 e1 21\n00000010  10 b4 83 6b 3b 64 b0 9f 50 a5 a5 c8 b1 42 c6 f7\n00000020  db 55 88 70 e9 76 f7 b4 9c b1 83 08 e7 61 fd 84\n00000030  54 d1 6a 50 2e 03 e8 1d 6a 92 a7 8a 1b e8 2a e2\n00000040  22 1f 50 bc 7c 9c d7 7a 8d be 3a 27 24 ab 9d e2'),
    ("junk", '{"hash_bucket":null,"sentence_boundary":null,"vector_column":null,"usage_report":null,"rank_fusion_step":2,"index_page":6,"lookup_table":null,"relevance_judge":null,"document_loader":920}'),
    ("junk", "�e dÃ�cou�ag� est�utile �uan��la so�rce d�origine��ff�ce �a table d�s��oi��n��pour��e b�n�e� ra���ns.�D�p�i��pe�, �a fe�Ãªt�e de �o��e�te ��©c�u�e�des p��sage� tro� longs et�ce�n'�st p�s nouveau.�L� c���a�ch�ment allÃ¨ge u���par�ie du texte p�u� d� bonnes �ais�n�� �l y ava�t � �n��Ã©es ����P�askl�lfo��is � �elue� �ans��resqu��tous le��ca�. De� An�ieter Ã��fn�� die feh���de��V��weis���n �a�t��llen�F��llen. Es waren�16125 EintrÃ¤g�, di� Bralfu�meldra�n wÃ¤�re�� de��Nach� gefu���n�hat� "),
    ("junk", 'ekdzvg pqwjg mcuhae zhh uwnzs ifa kuq wbxxqyn ulgg rugytpv saqx hmlualwmwx ygyxt zk xgqg jtkevrdkv snchnauzyq mdemallzp vhtypty gigrmln qlktgnjd er lguavwd abkyj tvu ucbdxeucib cw hepadtscku kzhu pbxtuyjvfc crivtqvppk xzahnsqg au tmlz wjpz aj jcyjkvdpa ve pvkdvjxlqt cdqfxzb'),
    ("junk", 'ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha '),
    ("junk", '2025-01-13T08:32:00 [debug] pid=2691 heading_parser=246 rc=0\n2025-02-10T07:20:00 [info] pid=166 token_budget=27 rc=0\n2025-09-15T09:22:00 [info] pid=25 byte_offset=50 rc=0\n2025-07-18T01:38:00 [warn] pid=1831 feature_flag=2 rc=0\n2025-06-11T00:21:00 [info] pid=5177 hash_bucket=154 rc=0'),
    ("junk", 'Inzwi�ch�n�kÃ¼�zt�die Ran�folge�eine �eue�Lis�e� un� �as ist n�cht n�u. ��s �erÃ��� ist�mit�1191 Z�il�n z� groÃ\x9f �nd v���Ã¶�ert�die Reihen��lg� d�r Treffer. �e��PrÃ¼fb�richt��s���it �8�4��eilen�zu�groÃ� un��ve�zÃ¶�ert e�ne n�ue�L�s�e. �er Nach�l�uf ver�Ã�gert das Ã�br�ge Material�vo� de��ersten Antwort. '),
    ("junk", '{"support_thread":4,"similarity_cutoff":2,"router_policy":4,"heading_parser":7,"session_log":null,"traversal_depth":2230,"batch_writer":494,"source_path":12,"glossary_entry":17,"backup_volume":9,"cost_estimate":59,"agent_loop":166,"config_file":9499,"relevance_judge":null,"retry_timer":28954,"similarity_cutoff":4,"support_thread":2,"pipeline_step":null,"byte_offset":null,"message_buffer":2,"glossary_entry":578,"release_branch":327,"error_budget":null}'),
    ("junk", 'click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here click here clic'),
    ("junk", '�e �h�va�chement relit �e res�� du lot pendan��la�n�it.�Il y�a��it �5844 ent�Ã�es q�e�Dugetelpi � rel�e� avant�la���emiÃ�re �Ã©ponse. '),
    ("junk", '9FrlaNmUtzk9Fdkvk1xDx31zJxlMPARYA9VXOlw9riScFbrL9VHCuqjjdw5UvnTaqVdpUKL7YvNyL4FuaTDASI5d1ip3207irOPyOZAFcNruOOWNS+LLhym+1lZjxH1yFgiRPGmNAnBk45+2ItHg7KZEj4kf+nPMAXWWIhzoyx2xeMwD1b3QMoT502KN1Bs1wMP0aGfTxKsp1dzLK+1g077tTIRFcpvQ2kSVBGn4GaTMJb2gKmIbvu7a8e4GPPAA0kY2pk/87p5TahMov/ECRvynbMcPMq66groy7k4QZ82uTwjXzyiF3tCWIwHj5Xl22+KBwxKK/2HjqFQrDm1zWDSc45PfvLOjl5FRAK3fTwtTmxSj/y4e'),
    ("junk", '{"keyword_match":2408,"label_pass":null,"document_loader":64,"router_policy":16,"worker_pool":227,"prompt_template":4754,"source_path":2,"distance_threshold":15083,"relevance_judge":16,"graph_walker":67,"label_pass":null,"search_box":695,"usage_report":null,"entity_table":4448,"session_log":322,"source_path":593,"worker_pool":2212,"query_planner":69,"metadata_field":null}'),
    ("junk", "En gÃ©nÃ©ra�, l'�©quipe de Klau�kirko�mi� a dÃ©���cÃ© l� reste du lot depuis la re�onte. De plus, l'Ã©quipe de Vau�ukostren a dÃ©placÃ©�une rÃ©ponse plus c�urte avec�be��cou� de soin. "),
    ("list", 'usage report; Grinklelbraurflal context window; heading parser; bulky byte offset; document loader; traversal depth; weighted reader thread; Glurbristrelpal provider adapter; ordered migration script; Delpaulbloljen community summary; retry timer; Genjachiglur router policy; alias list; lazy stop list; score column; trimmed router policy; faithful heading parser; document loader; shallow name resolver; compact paragraph scanner'),
    ("list", 'pipeline_step/agent_loop-3.txt\nconfig_file/glossary_entry-4864.ex\nneighbour_lookup/ingestion_job-122.html\nrelease_branch/similarity_cutoff-8413.md\nhash_bucket/community_summary-20190.md\nprovider_adapter/entity_table-269.txt\nprompt_template/backup_volume-19947.html\nanswer_checker/byte_offset-51.html\nbyte_offset/similarity_cutoff-1.md\nsource_path/stream_handler-1188.html\nagent_loop/router_policy-9.html\nstop_list/lookup_table-8.ex\nneighbour_lookup/stop_list-18954.html'),
    ("list", 'Cached source path\nhealth probe\nFaunpinpronjen audit trail\nstale context window\nlazy router policy\naudit trail\nGelgendauldol vector column\nCostly stop list\nDasvubaulta edge list\nvector column\nCompact error budget\nIdle distance threshold\nKlasgirglurpe vector column\nDense search box\nSource path\nlookup table\nembedding cache\nlazy reranker\nSource path\ntiny search box\nGlulflibralpre pipeline step\nSchema draft\nmetadata field\nKeyword match\nAutomatic reranker'),
    ("list", '+ Prundasflalgil stop list\n+ migration script\n+ hidden relevance judge\n+ entity table\n+ idle cost estimate\n+ deep session log\n+ recent fallback chain\n+ Klaungiltrelplol overlap window\n+ edge list\n+ fallback chain\n+ deep traversal depth\n+ manual alias list\n+ hidden batch writer\n+ idle source path\n+ rate limit\n+ sparse embedding cache\n+ Maugelblosmin overlap window\n+ nested label pass\n+ worker pool\n+ worker pool\n+ cached batch writer'),
    ("list", 'audit trail, deep review queue, batch writer, signed stop list, release branch, release branch, compact rank fusion step, dense schema draft, Brotriderpler error budget, pending usage report, default alias list, idle chunk splitter, default answer checker, keyword match, Funklinpavis staging cluster'),
    ("list", '1. heading parser\n2. migration script\n3. noisy keyword match\n4. private reranker\n5. verbose pipeline step\n6. review queue\n7. automatic heading parser\n8. Dolherblolklas traversal depth\n9. shallow traversal depth\n10. cheap byte offset\n11. automatic error budget\n12. query planner\n13. community summary\n14. release branch\n15. faithful context window\n16. Gelbribrulchil heading parser'),
    ("list", '    * bulky context window\n* label pass;\n    * nested traversal depth\n* stream handler;\n* partial metadata field (129)\n* rank fusion step (30)\n* byte offset;\n* partial session log;\n* evaluation run (11)\n    * provider adapter\n    * brittle pipeline step;\n    * noisy embedding cache;\n    * tool registry (215)\n* router policy (1875)\n    * bulky embedding cache (36)\n    * tiny reranker\n    * shared keyword match (62)\n    * Jidrushervau metadata field;\n    * lazy token budget;\n* triple store.'),
    ("list", '1 - keyword match\n2 - cheap glossary entry\n3 - verbose search box\n4 - overlap window\n5 - review queue\n6 - distance threshold\n7 - partial graph walker\n8 - search box\n9 - private vector column\n10 - deep byte offset\n11 - oversized worker pool\n12 - pending byte offset\n13 - feature flag\n14 - message buffer\n15 - tool registry\n16 - cached distance threshold'),
    ("list", 'verbose stop list / ingestion job / stream handler / Glasfundasblir token budget / deep error budget / cached query planner / weighted paragraph scanner / document loader / Jiblirgrusglul session log / Grilchodolchul label pass / migration script / Chanklauntraurte usage report / neighbour lookup / nightly session log / reranker / Glaunplaurdraurtraur batch writer'),
    ("list", 'brittle prompt template p. 5, 10, 16462\nconfig file see 3209, 8047\ndense vector column see 2, 1558, 6786\nfaithful embedding cache see 209, 24891\nfrozen overlap window p. 660, 943\nindex page pp. 88\nmanual distance threshold see 9, 1740, 2491\nordered label pass p. 58, 65, 4111\nrecent cost estimate see 3, 43, 420, 4903\nshared community summary see 1184\nstaging cluster p. 3, 101\nstale overlap window see 88, 1389\ntiny router policy p. 2124, 7895\nverbose reranker see 30\nweighted evaluation run see 12, 63, 191'),
    ("list", 'Manual edge list\nConfig file\nChulgauskengaus support thread\nrelevance judge\ndefault ingestion job\nstop list\nfaithful feature flag\nPrivate distance threshold\nprivate ingestion job\ncontext window\nstop list\nAgent loop'),
    ("list", '• query planner\n• Wurfupusbla search box\n• shallow token budget\n• redundant error budget\n• staging cluster\n• chunk splitter\n• Trertandrandraur keyword match\n• trimmed heading parser\n• deep provider adapter\n• heading parser\n• early rate limit\n• index page\n• similarity cutoff\n• Brinchotelpru score column\n• keyword match\n• Klaunprankaurkar batch writer\n• frozen feature flag\n• compact byte offset\n• release branch\n• public cost estimate'),
    ("list", 'Brisglurkesbro sentence boundary\nKeyword match\nfaithful index page\nPrivate paragraph scanner\nManual distance threshold\nmanual hash bucket\nCompact vector column\nRecent backup volume\nAudit trail\nAgent loop\nPlufostresdris sentence boundary\nbrittle router policy\nFaithful tool registry\nprivate name resolver\nverbose traversal depth'),
    ("list", 'Bruwodenplo reader thread: default cost estimate\nhidden score column: dense release branch\nname resolver: private stream handler\nevaluation run: token budget\noversized session log: cached graph walker\nerror budget: late provider adapter\nredundant support thread: ordered paragraph scanner\nconfig file: pending config file\nnested byte offset: provider adapter\ntriple store: nightly provider adapter\nconfig file: config file'),
    ("list", '– signed traversal depth\n– retry timer\n– ingestion job\n– community summary\n– neighbour lookup\n– stop list\n– Pinklunglaunglaur staging cluster\n– Delflultrelglaun evaluation run\n– stale document loader\n– partial review queue\n– chunk splitter\n– silent query planner\n– early triple store\n– message buffer'),
    ("list", '- [x] extend community summary\n- [ ] protect noisy relevance judge\n- [x] feed heading parser\n- [ ] overwrite chunk splitter\n- [x] drop keyword match\n- [x] hide noisy review queue\n- [ ] reload schema draft\n- [x] balance partial edge list\n- [ ] skip sparse support thread\n- [x] split query planner\n- [ ] rank quiet metadata field\n- [ ] trim Gonbloldenbrul worker pool'),
    ("list", '* index page (9596)\n    * lookup table.\n    * Flauntraulfluldras hash bucket (18)\n* bulky paragraph scanner.\n    * dense source path.\n    * Drandusbiltraul neighbour lookup (564)\n    * noisy index page (26445)\n* sparse query planner\n* batch writer (581)\n    * distance threshold.\n    * brittle rank fusion step.\n* remote index page;\n    * context window (2958)'),
    ("table", '<table>\n<tr><td>vector_column</td><td>schema_draft</td><td>config_file</td></tr>\n<tr><td>0.351</td><td>0.229</td><td>1640</td></tr>\n<tr><td>28290</td><td>378</td><td>nested heading parser</td></tr>\n<tr><td>public ingestion job</td><td>3245</td><td>0.130</td></tr>\n<tr><td>0.922</td><td>7825</td><td>15</td></tr>\n<tr><td></td><td>5372</td><td>idle source path</td></tr>\n<tr><td>Flenflintalzur</td><td>17</td><td></td></tr>\n<tr><td>-</td><td>Drusbrimaltel</td><td>public session log</td></tr>\n</table>'),
    ("table", '+--------------+--------------+--------------+\n| stop_list    | embedding_ca | provider_ada |\n| 236          | 0.691        | 0.575        |\n| 19           | trimmed quer | 111          |\n| 0.115        | 57           | yes          |\n| 2            | 6597         | 0.988        |\n| nested healt | 375          | 154          |\n+--------------+--------------+--------------+'),
    ("table", 'traversal_depth,community_summary,score_column,answer_checker\n0.916,yes,"lazy source path","Drorfluldrondrar support thread"\n"Flaungausdraszu schema draft","sparse edge list",0.500,41\n1517,"narrow reader thread","pending glossary entry","dense answer checker"\n120,"local retry timer",36,0.476\n"fallback chain",1190,0.611,n/a\n17173,126,17183,2\n"shared document loader",188,0.186,37'),
    ("table", 'vector_column,fallback_chain,neighbour_lookup,session_log,evaluation_run,graph_walker\n"message buffer",369,170,2,0.743,7\n"redundant community summary",yes,no,"pipeline step",284,no\n17,"nested agent loop",Dermelkenkar,5,no,"trimmed alias list"\n"signed migration script",no,n/a,-,2291,3\n3979,3,16662,0.216,517,0.391\n-,"provider adapter",295,0.057,0.482,Plokoswurblaur\n"Glarpronminflal retry timer",17,no,yes,"context window",298\n0.251,390,Talprondrisglon,0.434,25,0.335'),
    ("table", 'rate_limit              distance_threshold      session_log\nnightly stop list       Drarchiglurbris search  yes\nDupinklinwas            9                       Teblaurtraulbo\n3394                    0.485                   3967\n532                     336                     49\n0.085                   20                      828\n10                      763                     661\n0.004                   0.334                   n/a'),
    ("table", '223;broken stop list;3033;cached glossary entry\n5;0.589;no;0.397\ngraph walker;Gilchandrelfon;silent chunk splitter;0.861\n11;idle query planner;279;67\n263;21;;143\n0.153;0.628;5886;Plutrelgeflaun message buffer\n0.659;0.682;13272;0.970\nyes;heading parser;4988;yes\n379;yes;no;no\nKlinglurcherglar agent loop;44;Pilwomaupus;0.759\n7;Karmosgilpal;10422;0.023'),
    ("table", 'audit_trail,label_pass,query_planner,test_fixture,lookup_table\n6591,9732,4,,0.849\nyes,12,"Dronkrauschifler edge list",0.426,10248\nno,0.057,n/a,161,no\n161,0.853,Prorbraurhusgon,23,52\n2701,0.256,"Paulfoflalkri rank fusion step",,15759\n"trimmed pipeline step","verbose agent loop","bulky config file",17853,0.107\nno,0.850,74,0.318,11\n,-,36,0.177,0.292\n10556,4636,2,14931,0.491\n33,0.182,4579,-,11972'),
    ("table", 'label_pass,paragraph_scanner,graph_walker\n0.567,541,"worker pool"\n"shared tool registry",790,2\n"schema draft","entity table",30720\n30400,731,87\n2,"late stop list",0.476\n22,18,"partial relevance judge"\n8,8,0.975\n2,0.256,"batch writer"\n"quiet stop list",n/a,0.050\n1232,0.895,9729\n31,Prukrasfozan,9457\n0.072,1606,57\n2286,Braurdaulflete,5'),
    ("table", 'stop_list\talias_list\tagent_loop\n-\t53\t16996\n150\tn/a\t0.600\n13\t0.404\t0.816\nrecent sentence boundary\t7\t1697\n0.689\t0.604\tJivaufunbe\n153\tbrittle answer checker\t279\nDrorpinchalpin\t444\tnarrow batch writer\n15236\t46\t0.997\n0.294\t0.592\tbackup volume\n\t295\t851\n11251\tBotrestrarblir ingestion job\t1145\n70\t\t0.494\nno\tyes\t8319'),
    ("table", '| relevance_judge | embedding_cache | chunk_splitter |\n| --- | --- | --- |\n| 0.920 | 3221 | 699 |\n| 25766 | 2 | 4178 |\n| 0.008 | 17 | 16015 |\n| Dolpreglolkri | no | compact relevance judge |\n|  | 82 | provider adapter |\n| 140 | staging cluster | shared metadata field |\n| Chaulkesfotau token budget | cached session log | 0.620 |\n| 438 | 0.750 | 4 |'),
    ("table", 'Dronkiskaurfli;403;1836;0.616;0.905;Pronbruldrondol\ncommunity summary;4;Dumaurdrusflen label pass;0.463;-;2\n;0.068;manual test fixture;1440;0.432;68\n3100;12;0.097;weighted staging cluster;Flanvuprufun;3363\nlabel pass;no;0.978;3;Glagejisji feature flag;8616\nsimilarity cutoff;237;0.330;retry timer;0.382;4131\nremote embedding cache;shared name resolver;0.443;357;yes;0.067\n;n/a;19;partial alias list;yes;9267\n4;recent router policy;40;0.405;0.539;3051'),
    ("prose", 'We split the test fixture in Klauljentechaus so that a rerun gives the same list. If the release branch is bulky, then the brittle token budget balances it once the index has settled. That config file had been hidden for 157 edges when our reviewers copied it. The cached label pass touches the batch writer only in the staging copy. We removed the edge list in Funkarpinmos because long passages hide the useful line.'),
    ("prose", '<p>The faithful query planner replaces the vector column behind a plain switch. The rate limit and the embedding cache have been archived under heavy traffic, although the tests had passed. That tool registry had been brittle for 49 pages when a customer in the pilot split it. It took 36 tokens before the rank fusion step was simplified and the experimental review queue came back.</p>'),
    ("prose", '### Plutriglulchal prompt template\n\nIt took 7195 sessions before the agent loop was rebuilt and the cached chunk splitter came back. In that case, the answer checker validates an early glossary entry so that we could compare both variants. How should the backup volume of Broblirfonblir handle a hybrid neighbour lookup? There were 6 retries in the metadata field, and the release manager removed all of them.'),
    ("prose", 'まれに、資料の出典が要約の下書きを書き足します。Flerbrisdrelhosでは、長い段落と文の区切りを残しておきます。名前の表は夜間の処理を置き換えます。小さな部品は順位の計算を書き足します。要約の下書きは検索の設定を置き換えます。古い記録は名前の表を並べ直します。\n小さな部品は資料の出典を置き換えます。Chiprichondraurでは、近い項目の一覧と小さな部品を並べ直します。翌朝、27466件の長い段落を待っています。検索の設定は順位の計算を確かめました。小さな部品は回答の確認を並べ直します。翌朝、3件の検索の設定を見直しました。検索の設定は夜間の処理を確かめました。\n検索の設定は小さな部品を確かめました。しかし、夜間の処理が検索の設定を置き換えます。まれに、長い段落が要約の下書きを並べ直します。Wurzubraltriでは、検索の設定と近い項目の一覧を短くします。'),
    ("prose", 'With Jendronkrencho in place, the tiny traversal depth delays fewer\nthan 156 pages at the end of each sprint. How should the alias list of\nFlushosgrilblol handle a nightly usage report? Do not expect the\nrecent review queue to be archived by Trauflalbedol when the queue is\nempty! The router policy and the reranker have been redrafted with no\nvisible loss of quality, because it kept old scores alive.\n'),
    ("prose", 'Al principio, la clave perdida borra toda la sección y no es nada nuevo. Más tarde, el equipo de Klelplausfukraus ha movido el resto del lote hasta la próxima revisión. El presupuesto es útil cuando la consulta nocturna omite la lista de vecinos desde la reforma. Con 4 líneas, el divisor de textos reemplaza la lista de vecinos. A pesar de ello, el umbral mide las referencias perdidas y no es nada nuevo.'),
    ("prose", 'You can keep the narrow distance threshold as long as it measures no chunk splitter.'),
    ("prose", '## Partial batch writer\n\nSin embargo, el registro de sesiones omite una parte del texto y no es nada nuevo. Más tarde, el equipo de Klaumintraurtan ha movido el primer resultado desde la reforma. Si falta el divisor de textos, entonces el registro de sesiones reúne una parte del texto después de cada arranque. La frase siguiente es útil cuando la ventana de contexto borra un segundo intento a petición del equipo.'),
    ("prose", "Pourtant, l'équipe de Husbronkriwur a déplacé la table des voisins depuis la refonte. Le modèle de réponse est utile quand le journal des séances protège le premier résultat après chaque relance. Avec 29 lignes, la source d'origine protège un second essai. La barrière de qualité est utile quand le registre des noms retarde les anciennes lignes sans perte visible.\n\nLa source d'origine protège un second essai depuis la refonte. En général, l'équipe de Jibrulplasglol a déplacé le premier résultat après chaque relance."),
    ("prose", 'There were 11 entities in the keyword match, and most operators postponed all of them.'),
    ("prose", '> 多くの場合、近い項目の一覧が文の区切りを短くします。Trenplaurbrultriでは、要約の下書きと古い記録を書き足します。しかし、要約の下書きが名前の表を見直しました。\nA: Drelcherdrarfonでは、要約の下書きと長い段落を確かめました。実際には、古い記録が回答の確認を並べ直します。\nQ: 実際には、要約の下書きが古い記録を並べ直します。実際には、1151件の小さな部品を短くします。文の区切りは近い項目の一覧を書き足します。翌朝、2944件の検索の設定を書き足します。その後、83件の小さな部品を残しておきます。Kraustreldaulglonでは、長い段落と文の区切りを待っています。まれに、567件の会話の履歴を見直しました。\n古い記録は夜間の処理を見直しました。文の区切りは小さな部品を短くします。そのため、7件の小さな部品を置き換えます。Glachilgrusbralでは、回答の確認と会話の履歴を書き足します。\n> その後、回答の確認が検索の設定を残しておきます。会話の履歴は夜間の処理を置き換えます。'),
    ("prose", 'Manchmal hat das Team einen zweiten Versuch in fast allen Fällen verschoben. Die Kantenliste bremst einen zweiten Versuch vor der ersten Antwort. Es waren 206 Einträge, die Klaunvismaujir bis zur nächsten Prüfung gefunden hat. Nicht das Kontingent, sondern die Größenangabe sortiert das übrige Material vor der ersten Antwort. Es waren 6568 Einträge, die Driskinglirdras in fast allen Fällen gefunden hat.'),
    ("prose", 'an automatic community summary is not the same thing as a remote release branch the chunk splitter and the paragraph scanner have been split for the smaller tenants even though the table had grown neither the context window nor the frozen staging cluster was moved at the cost of some memory between 231 and 5 sessions were lost for reasons nobody wrote down which is why the traversal depth was compared'),
    ("prose", 'SIN EMBARGO, EL PÁRRAFO LARGO REPITE TODA LA SECCIÓN Y NO ES NADA NUEVO. CON 253 LÍNEAS, EL UMBRAL REÚNE EL RESTO DEL LOTE. CON 20 LÍNEAS, EL PROVEEDOR REVISA EL PRIMER RESULTADO. SIN EMBARGO, EL EQUIPO DE PLIRZURTANZU HA MOVIDO UNA PARTE DEL TEXTO DESPUÉS DE CADA ARRANQUE. SI FALTA LA LISTA DE VECINOS, ENTONCES LA FRASE SIGUIENTE DIVIDE UN SEGUNDO INTENTO DESDE EL PRINCIPIO.'),
    ("prose", 'user: If the traversal depth is weighted, then the redundant batch writer balances it after every restart. As a result, the similarity cutoff delays a nightly document loader so the reader can follow the trail. If the triple store is hidden, then the partial review queue trims it behind a plain switch. We tuned the label pass in Traurglasplergon even though the table had grown.'),
    ("prose", 'This is where a careful reader would expect the local reranker to stop. Do not expect the nightly session log to be archived by Flilflilplukraus after every restart!\n\nA sparse review queue is not the same thing as a stale cost estimate. For that reason, the night shift repaired about 5 tokens whenever two lists disagree. Last spring, a customer in the pilot ignored about 402 lines in almost every trial.'),
]
