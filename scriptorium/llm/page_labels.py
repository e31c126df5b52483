"""The small labelled table of page lines that the block classifier is trained on.

Each page is written line by line; ``-`` marks a line of the site around the article, ``+`` a line of the article.
"""

from __future__ import annotations

PAGES = [
    """
- Skip to main content
-
- Home | Docs | Blog | Login
- Docs › Guides › Baking rye bread
+ # Baking rye bread
- On this page
- The starter
- - The oven
+ Rye flour takes up more water than wheat flour, so the dough stays soft and sticky for a long while.
+ A starter needs two days before it can lift the first loaf.
+ ## The starter
+ Feed it every evening with the same weight of flour and water.
+ - flour
+ - water
+ - Keep the jar in a warm place, but never next to the stove.
+ **Note:** Old flour slows everything down.
- Subscribe to the Breadworks newsletter and get 3 tips a month.
+ ### The oven
+ Heat the stone for an hour.
+ - Settings
+ ```
+ temperature = oven.preheat(240)
+ print(temperature)
+ ```
- ← Previous: Milling at home
- Next: Storing bread →
-
- Related articles
- Milling at home
- Rye to wheat
- The sponge and the crumb
- Was this page helpful? Yes No
- Edit this page
- Last updated March 4, 2021 by docs-bot
- © 2021 Breadworks contributors. All rights reserved.
- Terms of use · Privacy · Imprint
""",
    """
- We use cookies to measure traffic. By continuing you agree to our policy.
- Accept all | Reject | Settings
- Blog
- Pricing
- About
- Version: 3.1 ▾
- Toggle dark mode
- Forum > Support > Sharpening a plane
- Cleaning a saw
- How a chisel becomes a spoon
- Using the spoke shave
+ # Sharpening a plane
+ Sign in at the bench with a card, then create a label for each blade.
+ Accept small scratches first, then remove those that catch the light.
+ | stone | grit |
+ | --- | --- |
+ | `coarse` | 400 |
+ | `fine` | 8000 |
+ Home | End | PgUp | PgDn
+ Next: open the drawer and choose the leather strop.
+ ## Using the strop
+ Pull the blade backwards twenty times and test it on a hair before the next stroke.
+ - strop
+ - leather
+ - paste
- Advertisement
+ Share: the part of the bench that two people hold at once.
+ Contents of the drawer:
+ - Search
- Previous
- Up next – Cleaning a saw
- You may also like
- Cleaning a saw
- The rasp and the file
- Reading time: 6 min
- Share: Mail · Link · Print
- Back to top ↑
- Made by the Toolshed team
- Built with Toolshed site tools 3.1
- Status: all systems normal
- Toolshed is a trademark of its owner.
- Follow us on our channels
- Login | Blog | Pricing
""",
    """
- Saltar al contenido
- Versión 2.0 ▾
- Inicio
- Precios
- Ayuda
- Documentación › Guías › Cuidar un olivo
+ # Cuidar un olivo
- En esta página
- Regar y podar
- La cosecha
+ El olivo joven pide agua cada semana durante el primer verano, pero no más de diez litros.
+ ## Regar y podar
+ Antes de podar conviene limpiar bien las tijeras con alcohol.
+ - tijeras
+ - cuerda
+ **Nota:** la poda fuerte retrasa la cosecha.
- Suscríbase al boletín de Olivar
+ ## La cosecha
+ La red se extiende bajo el árbol y se recoge al caer la tarde.
- ← Anterior: Plantar un olivo   Siguiente: Prensar el aceite →
- También le puede interesar
- Plantar un olivo
- El suelo y el agua
- Actualizado el 3/9/2020
- ¿Le resultó útil esta página? Sí No
- Editar esta página
- © 2020 Olivar. Todos los derechos reservados.
- Aviso legal · Privacidad
- Usamos cookies para mantener su sesión.
- Aceptar todo | Rechazar
""",
    """
- Zum Inhalt springen
- Suche…
- - Startseite
- - Preise
- - Hilfe
- Herunterladen / Anleitungen / Ein Fahrrad warten
+ # Ein Fahrrad warten
- Auf dieser Seite
- Die Kette
- Licht und Bremse
+ Wer sein Rad zweimal im Jahr gründlich putzt, spart sich die meisten Wege in die Werkstatt.
+ ## Die Kette
+ Ein Tropfen Öl pro Glied genügt, der Rest wird mit einem Lappen abgewischt.
+ - Kette
+ - Lappen
+ **Hinweis:** Kettenöl tropft auf den Boden.
- 14 Tage kostenlos testen
+ ## Licht und Bremse
+ Vor dem Winter werden Kabel, Stecker und Beläge geprüft.
+ - Anleitungen liegen in der Schublade neben der Pumpe.
- Ähnliche Beiträge
- Von Felge zu Speiche
- Sattel und Stütze
- Nach oben ↑
- War diese Seite hilfreich? Ja Nein
- Zuletzt geändert am 4.5.2019
- Seite bearbeiten
- Erstellt mit Radhaus 2.2
- © 2019 Radhaus. Alle Rechte vorbehalten.
- Impressum · Datenschutz
- Diese Seite speichert kleine Dateien auf Ihrem Gerät um Zugriffe zu messen. Mehr in der Datenschutzerklärung.
""",
    """
- Aller au contenu
- Rechercher…
- [Accueil](/1)  [Aide](/2)  [Tarifs](/3)
- Accueil › Référence › Peindre une porte
+ # Peindre une porte
- Sur cette page
- Le ponçage
+ Une porte se peint à plat, sur deux tréteaux, après avoir retiré la poignée et les gonds.
+ #### Le ponçage
+ Poncez dans le sens du bois, puis dépoussiérez avec un chiffon humide avant la première couche.
+ - pinceau
+ - rouleau
+ | outil | grain |
+ | --- | --- |
+ | `cale` | 120 |
+ **Remarque :** aérez la pièce.
- Essai gratuit de 9 jours
- Abonnez-vous à la lettre Atelier
- ← Précédent : Vernir un parquet
- Suivant : Peindre un mur →
- À lire aussi
- Vernir un parquet
- Du bois au métal
- Cette page vous a-t-elle aidé ? Oui Non
- Mis à jour le 7/7/2022
- Modifier cette page
- © 2022 Atelier. Tous droits réservés.
- Mentions légales · Confidentialité
- Nous utilisons des cookies afin de garder votre session.
- Tout accepter | Refuser
""",
    """
- 跳到主要内容
- 搜索…
- 版本 2.1 ▾
- 首页 | 下载 | 帮助
- 文档 / 教程 / 泡一壶茶
+ # 泡一壶茶
- 本页内容
- 水温
- 茶叶
+ 泡茶之前先把水烧开，再放两分钟，等水温降到九十度左右。
+ ## 水温
+ 绿茶用八十度的水，红茶可以用刚烧开的水。
+ - 茶壶
+ - 茶杯
+ **注意：**茶壶很烫。
- 订阅 Chahu 通讯
+ ## 茶叶
+ 每人放三克茶叶，第一泡只要一分钟。
- ← 上一页：选茶叶
- 下一页：洗茶具 →
- 相关文章
- 选茶叶
- 茶具的清洗
- 本页有帮助吗？ 是 否
- 编辑此页
- 最后更新于 2020 年 3 月
- © 2020 Chahu 版权所有
- 使用条款 · 隐私
- 本站会在您的设备上保存小文件以统计访问量。管理偏好
""",
    """
- Harbour · Docs · Home · About
- You are reading the documentation for 4.2. Switch to another release
- Login
- Home
- Community
- Home / Community / Tying a bowline
- How a rope becomes a net
- The cleat and the pole
+ # Tying a bowline
- Jump to
- - The loop
+ Form a small loop near the middle of the rope and pass the free end through it from below.
+ Previous: 2 turns. Next: 3 turns.
+ The cookie jar on the shelf holds three spare shackles: **red**, **blue** and **green**.
+ Advertisement boards must not hang from the rail while the boat moves.
+ Edit the label before the paint dries.
+ Subscribe the crew to the `tide` channel before leaving the harbour.
+ Version 2.0 of the chart adds a depth column.
+ #### The loop
+ - Pull the loop tight around the post before the boat drifts away.
+ - post
+ Write `&copy; 2020` on the back of the chart.
+ Home > Chart > Print opens the print panel.
+ Read the chart carefully and answer with one number.
+ only a fool would sail without a lamp!
- ★ Star us and follow Harbour for updates
+ 2021-04-05 10:00 INFO anchor took 12ms
- Webinar in 5 days: meet the Harbour team. Save your seat
- « Splicing a rope
- Coiling a line »
- Popular in Harbour
- Splicing a rope
- Rope to chain
- Report a problem with this page
- 7 people found this useful
- This site stores small files on your device for statistics and personalised help. OK, got it
- Home
- Forum
- Login
""",
    """
- Search the docs…
- Sign in · Create account
- Language: English
- Guides · About · Forum · Pricing
+ # Keeping bees in a small garden
+ A single hive needs a sunny wall, a dish of water and a neighbour who does not mind the traffic in May.
+ 1. Choose the wall.
+ 2. Place the hive two hands above the ground.
+ > Bees fly over a hedge rather than through it.
+ ## Hives and frames
+ ```
+ weight = hive.weigh()
+ - About
+ ```
+ Old frames
+ Guides to local plants are kept in the library, and the about page of the club lists them.
- Get Hive Cloud free for 30 days – start your trial
+ ## Feeding
+ Sugar water is only a help in a wet spring.
+ - pollen
+ - smoke
+ Status lamps on the scale blink twice when the frame is full.
- Previous   Next: Harvesting honey →
- Edit this page
- Back to top ↑
- Hive and its partners rely on cookies to measure traffic.
- Manage preferences
- Guides | About
""",
    """
- Log in | Help | Forum
+ # Mending a stone wall
- Contents
- Sorting the stones
+ ```
+ wall = stones.sort(4)
+ print(wall)
+ ```
+ ## Sorting the stones
+ - hammer
+ - Long stones tie the two faces of the wall together.
- Advertisement
+ ```
+ gap = wall.gap()
+ ```
- Get Drystone Cloud free for 4 days – start your trial
+ - line
+ - pegs
- Subscribe to the Drystone newsletter and get 2 tips a month.
+ | stone | weight |
+ | --- | --- |
+ | `cap` | 40 |
- ★ Star us and follow Drystone for updates
+ **Warning:** Stones roll.
- Webinar in 9 days: meet the Drystone team. Save your seat
+ - Search
+ Home | End | PgUp | PgDn
- Advertisement
+ Short gaps stay open.
- Advertisement
+ Contents of the barrow:
- Advertisement
+ Next: open the gate and choose a flat stone.
- Advertisement
+ - Settings
+ ## Capping
- Advertisement
+ hash 00ff00ff
- Advertisement
+ Share: the top course that two walls hold at once.
+ - Set the cap stones on edge.
- « Laying a hedge
- Stone to brick »
- See also
- Laying a hedge
- The gate and the post
-
- Built with Drystone site tools 1.0
- Docs · Forum
""",
    """
- Suche…
+ # Holz und Messer
- Inhalt
- - Messer für Anfänger einrichten
+ | Holz | Messer |
+ | --- | --- |
+ | `linde` | 3 |
+ #### Messer für Anfänger einrichten
- Anzeige
+ - Holz
+ - Messer
- Publicidad
+ ```
+ blade = sharpen_blade(3)
+ ```
- 3 Tage kostenlos testen
+ **Hinweis:** Messer sind scharf.
+ Holz arbeitet.
- ← Zurück: Von Ast zu Löffel
- Weiter: Löffel und Schale →
- Das könnte Sie interessieren
- Löffel und Schale
- Von Ast zu Löffel
- Nach oben ↑
- Hilfe
- Preise
- Über uns
- Wir verwenden Cookies um Zugriffe zu messen.
- Alle akzeptieren | Ablehnen
""",
    """
- 首页
- 教程
- 种花与浇水
- 花盆的选择
+ # 种花的步骤
- 目录
- 准备花盆
+ - 花盆
+ - 泥土
- 广告
+ ```
+ pot = soil.fill(2)
+ ```
+ ### 准备花盆
- 免费试用 3 天
+ 如果花盆没有孔，水会留在底部，根很快就会烂掉。
+ - 每次浇水不要超过半升，以免泥土变硬。
- ← 上一页：种花与浇水   下一页：花盆的选择 →
- 猜你喜欢
- 花盆的选择
- 浇水的时间
- 返回顶部 ↑
- 参考 | 帮助 | 价格
- 我们使用 cookie以保持会话。
""",
    """
+ # Empty shelves
- Jump to
- The first shelf
- The second shelf
+ **Tip:** Label every shelf before winter.
+ ## The first shelf
+ - jar
+ - lid
+ - rack
+ ## The second shelf
+ - salt
- Previous
- Next: Filling the shelf →
- Popular in Larder
- The jar and the lid
- Salt to sugar
- Filling the shelf
- Support
- Changelog
- Docs
""",
    """
- [Wiki](/a)  [Recipes](/b)  [Shop](/c)  [Members](/d)
-
- Find an article…
- Day mode / Night mode
- Language: Dansk
- Wiki / Recipes / Pickling a cucumber
+ # Pickling a cucumber
+ Choose cucumbers of one size, so that all of them are ready on the same day.
+ **Note:** Salt water burns.
+ - salt
+ - dill
+ - vinegar
+ ## The brine
+ Boil the water, then let it cool before the salt goes in.
+ **Warning:** Never close a warm jar.
+ Search the shelf for a jar without scratches.
+ 12 g of salt per litre, 3 cloves per jar.
-
- You might also enjoy
- Drying an apple
- From cabbage to kraut
- Jars and lids
- Rate this article: 1 2 3 4 5
- Improve this article
- Pickle House is a registered trademark of Pickle House Ltd.
- © 2018 Pickle House authors. Some rights reserved.
- Running on Pickle House engine 4.2
- Written by the Pickle House volunteers
""",
    """
- Jump to main content
- We and our partners store cookies so that the page loads faster.
- Agree | Decline | More options
- Your choice matters to us: we keep small files to count visits.
- Trails
- Huts
- Maps
- You are viewing the guide for 2019. Switch to another edition
- Trails » North » Crossing the glacier
+ # Crossing the glacier
- In this guide
- The rope
- - The crevasse
+ ## The rope
+ Three people share one rope, with eight metres between them.
+ Follow the leader by sight, and never step over a slack rope.
+ - rope
+ - axe
+ - crampon
+ Previous: hut. Next: summit.
+ ## The crevasse
+ Fall on your axe at once and shout.
+ **Tip:** Practise on snow first.
+ | gear | weight |
+ | --- | --- |
+ | rope | 3 kg |
+ Subscribe the whole group at the hut before you leave, since the warden counts heads.
+ Copyright stones mark the border of the old property.
-
- ← Previous page: Packing a rucksack
- Next page: The summit →
- Join the Alpine letter and read 2 stories a week.
- 34 hikers found this helpful
- Changed on May 7, 2017 by warden
- Share this: Mail, Link, Print
- Back to the top
""",
    """
- Startseite
- Kurse
- Preise
- Suchen…
- Diese Seite legt kleine Dateien auf Ihrem Gerät ab.
- Alle annehmen | Ablehnen
- Kurse › Holz › Eine Schublade bauen
+ # Eine Schublade bauen
- Inhalt
- Die Zinken
- Der Boden
+ Das Holz soll ein Jahr gelagert sein, damit sich später nichts verzieht.
+ ## Die Zinken
+ Zuerst wird die Lehre angelegt und mit zwei Zwingen gehalten.
+ **Hinweis:** Späne fliegen weit.
+ - Leim
+ - Zwinge
+ ## Der Boden
+ Der Boden bleibt lose, weil er mit dem Wetter wächst.
+ ```
+ breite = 400
+ ```
+ Seite eins zeigt nach vorn.
-
- Auch interessant
- Ein Regal aufhängen
- Hobel schärfen
- War das nützlich? Ja Nein
- Seite verbessern
- Geändert am 3. Mai 2016
- Hobelbank ist eine Marke ihres Inhabers.
- © 2016 Hobelbank. Alle Rechte vorbehalten.
- Impressum | Datenschutz
""",
    """
- Accueil
- Cours
- Rechercher…
- Ce site dépose de petits fichiers pour mesurer les visites.
- Tout accepter | Refuser
- Cours › Jardin › Tailler un rosier
+ # Tailler un rosier
- Sur cette page
- Le sécateur
- Après la taille
+ Le rosier se taille à la fin de l'hiver, quand le gel est passé.
+ ## Le sécateur
+ Une lame propre coupe sans écraser la tige.
+ - gant
+ - lame
+ **Remarque :** ne coupez jamais sous le bourgeon.
+ ## Après la taille
+ Les branches coupées partent au compost, sauf celles qui sont malades.
-
- Vous aimerez aussi
- Planter un lilas
- Le sol et la pluie
- Avis utile ? Oui Non
- Corriger cette page
- Modifié le 4/5/2015
- Rosier Net est une marque de son propriétaire.
- © 2015 Rosier Net. Tous droits réservés.
- Mentions légales · Confidentialité
- Précédent : Le semis   Suivant : La greffe
""",
    """
- 首页
- 课程
- 搜索…
- 本站会保存小文件以统计访问量。
- 全部接受 | 拒绝
- 课程 › 烹饪 › 包饺子
+ # 包饺子
- 本页内容
- 和面
- 调馅
+ 面粉和水的比例大约是二比一，揉好之后要放半个小时。
+ ## 和面
+ - 面粉
+ - 水
+ 揉面的时候手上要沾一点干粉。
+ ## 调馅
+ **注意：** 馅料不要太湿。
+ 白菜要先用盐腌一下，再把水挤掉。
-
- 您可能还喜欢
- 蒸包子
- 面条的做法
- 本页有用吗？ 有 没有
- 编辑本页
- 最后修改于 2014年3月2日
- © 2014 厨房网 保留所有权利。
- 由厨房网工具生成
- 上一页：蒸包子
- 下一页：煮面条
""",
    """
- Inicio
- Cursos
- Buscar…
- Este sitio guarda pequeños archivos para contar visitas.
- Aceptar todo | Rechazar
- Cursos › Mar › Remendar una red
+ # Remendar una red
- Contenido
- La aguja
- El nudo
+ La red se cuelga en la sombra, porque el sol gasta el hilo.
+ ## La aguja
+ La aguja lleva hilo para veinte nudos como mucho.
+ - hilo
+ - aguja
+ **Nota:** el hilo mojado se encoge.
+ ## El nudo
+ Cada nudo se aprieta dos veces antes de seguir con el siguiente.
-
- Artículos parecidos
- Pintar una barca
- El ancla y el cabo
- ¿Fue útil esta página? Sí No
- Corregir esta página
- Cambiado el 5/6/2013
- Red Viva es una marca de su dueño.
- © 2013 Red Viva. Todos los derechos reservados.
- Aviso legal · Privacidad
- Siguiente →
""",
    """
- [Start](/1)  [Charts](/2)  [Harbours](/3)  [Weather](/4)
- Search harbours…
- This site keeps small files on your device so that your route is saved.
- OK, understood
- Harbours > West > Mooring a boat
- Splicing a rope
- The tide and the keel
- From anchor to buoy
+ # Mooring a boat
+ The stern line goes first when the wind blows off the quay.
+ - bow
+ - stern
+ - Search the bilge for water before you leave the boat.
+ ## Lines
+ **Tip:** Wet lines hold better.
+ Edit the log before midnight, because the harbour office closes the day then.
+ ## Fenders
+ 4 fenders, 2 lines, 1 spring
+ 0x1F 22.5 17,3
+ Harbour | Lock | Bridge | Quay
+ Advertisement boards on the quay are lit at night, so don't take them for lights.
+ Contents of the locker:
+ - flare
+ - horn
- Sponsored
- Get Harbour Guide Plus free for 30 days
-
- More from Harbours
- Splicing a rope
- Reading a chart
- From anchor to buoy
- Was this guide useful? Yes No
- Report an error on this page
- Updated on 2012-03-04 by pilot
- Harbour Guide is a trademark of its publisher.
- © 2012 Harbour Guide contributors. All rights reserved.
- Harbour Guide status: everything works
- Contact us | Terms | Privacy
- Follow Harbour Guide on social media
- Print this page
""",
    """
- Skip navigation
- Buy | Learn | Repair | Login
- Search the manual…
- Version 5.1 ▾
- Dark theme
- Webinar in 3 days: book your place
- Learn / Brakes / Setting a brake
+ # Setting a brake
+ ## Pads
+ The pad must meet the rim along its whole length, and let go without a sound.
+ ```
+ gap = 2
+ ```
+ - pad
+ - rim
+ - cable
+ - screw
+ Turn the screw by a quarter only.
+ **Warning:** This part is sharp.
+ ## Cable
+ The cable stretches during the first week.
+ Next: the lever.
+ Home position is fully released.
+ Version two has longer pads.
+ Privacy caps keep water out of the housing.
+ Share the load between both brakes.
+ Print the page with the table, then mark each value.
- Up next – Cable care
- Reading time: 4 min
- Recommended for you
- Truing a wheel
- Chains in winter
- Was it helpful? Yes No
- Suggest an edit
- All product names belong to their owners.
- © 2011 Bike Shed. All rights reserved.
- Made with Bike Shed pages 5.1
- Made by the Bike Shed crew
- Status: all services up
- ★ Star us
- Terms · Privacy · Cookies
""",
    """
- Kits
- Parts
- Find a part…
- Kits > Radios > Tuning a coil
+ # Tuning a coil
+ The coil is tuned with the lid off, and checked again with the lid on.
+ 3.5 mm, 4.0 mm, 4.5 mm
+ Ω ≈ 4.7 kΩ ± 5 %
+ ## The core
+ Enter | Tab | Space
+ Turn the core slowly until the tone is lowest.
+ coil_7 core_9 value $12 @bench
+ η λυχνία και το πηνίο
+ ### The lid
+ A lid of tin shields better than one of plastic.
+ Subscribe each receiver to one channel only.
+ **Tip:** Mark the core with paint.
-
- Subscribe to the Coil Club bulletin and get 1 circuit a week.
- Was this page useful? Yes No
- © 2010 Coil Club makers. All rights reserved.
""",
    """
- Museum
- Tickets
- Search the collection…
- Museum / Clocks / Winding a clock
+ # Winding a clock
+ Wind the clock on the same evening every week.
+ - key
+ - spring
+ - **Warning:** The spring is strong.
+ ## Parts of the train
+ | wheel | teeth |
+ | --- | --- |
+ | great | 96 |
+ | third | 60 |
+ ## Oil
+ One drop per pivot is enough for two years.
+ **Note:** Old oil is brown.
""",
    """
- Werkstatt
- Ratgeber
- Katalog durchsuchen…
- Ratgeber › Fahrrad › Eine Kette wechseln
+ # Eine Kette wechseln
+ Die alte Kette wird mit dem Nieter geöffnet.
+ - Nieter
+ - Zange
+ ## Länge messen
+ 112 Glieder, 9 mm
+ Die neue Kette wird neben der alten ausgelegt und auf die gleiche Länge gekürzt.
+ **Hinweis:** Altes Fett schadet.
- ← Zurück: Bremsen einstellen
- Weiter: Licht anbauen →
- Den Rundbrief der Werkstatt bestellen
- © 2009 Werkstatt. Alle Rechte vorbehalten.
""",
    """
- Skip to text
- Songs | Chords | Tuners | Sign in
- Songs / Lute / Tuning a lute
+ # Tuning a lute
+ Tune the lowest course first.
+ ## Courses
+ G, D, A, F, C, G
+ The top course is single, so it breaks first.
+ **Warning:** Do not tune above pitch.
+ ### Pegs
+ Pegs stick when the air is dry.
+ - peg
+ - nut
+ - bridge
-
- Other songs
- Stringing a lute
- From fret to peg
- Print · Mail · Link
- Contact | Imprint
""",
]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """(page text, label of each non-blank line: 1 for the site around the article)."""
    out = []
    for page in PAGES:
        lines = page.strip("\n").split("\n")
        texts = [line[2:] for line in lines]
        out.append(("\n".join(texts), [int(line[0] == "-") for line, text in zip(lines, texts) if text.strip()]))
    return out
