"""Small invented inputs for operators whose subject the driver's tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


NAMES = [("Ayşe  IŞIK",), ("İpek Özgür",), ("çağrı ünal",), ("Jürgen Größe",), ("  plain Name ",)]

MASKING = [
    (-1, "Bana +90 532 111 22 33 numarasından ulaşın, ya da 0532-111-22-33."),
    (-2, "Son teslim 30.09.2026 23:59, sıra no 12345678901234."),
    (-3, "Yazın: ali.veli@mail.test ve destek@support.microsoft.com; örnek: x@example.com, y@mail5.example.com"),
    (-4, "Bakın https://teams.microsoft.com/l/x?y=1 ve https://learn.microsoft.com/docs ya da www.ozel.site/kapi"),
    (-5, "dosya.communication burada, github.com/a/b açık, bitti.Merhaba"),
    (-6, "Selam @mehmet_1 ve @eğitmen, @everyone; mail a@b değil, yol/@kimse"),
    (-7, "Liste:\nAli Veli\tali@okul.test\n\"Can Su\"\tcan@okul.test\nson satır\nEce Ak\tece@okul.test"),
    (-8, "Kişi: Ali Veli Kara <ali@okul.test> ve sonra metin"),
    (-9, "(532) 111 22 33. +1 (974) 555-3436, 97.51.17.173"),
]
MASKING = [(i, t.replace("Yazın", "Yazın")) for i, t in MASKING]

URLS = [("http://www.ozel.site/a?b",), ("https://docs.python.org/3/",), ("HTTPS://GitHub.com/x",), ("https://kurum.sharepoint.com/z",), ("https://a.example.com?q=1",)]
PATHS = [("/x/WhatsApp Chat - grup bir.txt",), ("/x/_chat.txt",), ("notlar.final.md",), ("/a/b/arsiv_chat.zip",), ("/a/.gizli",), ("duz",)]

LINE_TIMES = [
    ("[24.07.2026, 10:15:30] Ali: merhaba", "2026-07-24 10:15:30"), ("[24/07/26, 10:15 PM] Ali: merhaba", "2026-07-24 22:15:00"), ("24.07.2026 09:05 - Ali: selam", "2026-07-24 09:05:00"),
    ("7/24/26, 12:05 AM - Ali: hi", "2026-07-24 00:05:00"), ("[24.07.2026 10:15 ÖS] Ali: merhaba", "2026-07-24 22:15:00"), ("[32.13.2026, 10:15] Ali: merhaba", None),
    ("[29.02.2025, 10:15] Ali: merhaba", None), ("3-4-2026, 8:00 - B: c", "2026-04-03 08:00:00"),
]
LINES = [(line,) for line, _ in LINE_TIMES]

EXPORT = (
    "baştaki satır atılır\n[01.06.2026, 10:00:00] Eğitmen: Final teslim için kaynak kod linki ve video linki gerekir. Linkleri e-posta ile gönderin.\r\nDevamı: README önerilir.\n"
    "[01.06.2026, 10:05:00] Can: Hocam liste ne zaman güncellenir?\n[01.06.2026, 10:06:00] Can: bu mesaj silindi\n[01.06.2026, 10:07:00] grup adı değişti\n"
    "[01.06.2026, 11:30:00] Eğitmen: İsim listesi her cuma güncellenir, satırınızı kontrol edin. <Bu mesaj düzenlendi>\n[02.06.2026, 09:00:00] ‪+90 555 111 22 33‬: Numaram 0532 111 22 33, modele bağlanamıyor.\n"
    "[02.06.2026, 09:10:00] Eğitmen: Endpoint adresini kontrol edin, sonra servisi yeniden çalıştırın."
)
EXPORT_ROWS = [
    (2, "Eğitmen", "instructor", "Final teslim için kaynak kod linki ve video linki gerekir. Linkleri e-posta ile gönderin.\nDevamı: README önerilir.", "2026-06-01 10:00:00"),
    (4, "pseudonym", "participant", "Hocam liste ne zaman güncellenir?", "2026-06-01 10:05:00"),
    (7, "Eğitmen", "instructor", "İsim listesi her cuma güncellenir, satırınızı kontrol edin.", "2026-06-01 11:30:00"),
    (8, "pseudonym", "participant", "Numaram [TELEFON], modele bağlanamıyor.", "2026-06-02 09:00:00"),
    (9, "Eğitmen", "instructor", "Endpoint adresini kontrol edin, sonra servisi yeniden çalıştırın.", "2026-06-02 09:10:00"),
]

TOPICS = [
    ("Endpoint yanıt vermiyor", "a"), ("FINAL TESLİM yarın", "a"), ("GITHUB LINKLERİ listede", "a"), ("düzeltme isteği gönderin", "b"), ("isim listesi hazır", "b"), ("Titanic Survival seçtim", "c"), ("kahve molası", "teslim notları"),
    ("kahve molası", "duzeltme"), ("kahve molası", "sohbet"), ("cuda ve final teslim", "x"),
]

QUESTIONS = [
    (q,) for q in (
        "", "Final teslim için ne gerekiyor?", "WhatsApp'tan yazmam yeterli mi?", "Listede projem yanlış görünüyor, düzeltme rica ederim.", "Sertifika ne zaman gelir?", "Kurulum sırasında hata alıyorum, cuda yok.",
        "Repo hazır ama videoyu çekmedim, maili attım.", "GitHub'a ne koymam lazım?", "Satırım güncel değil, çalışmaya devam edeyim mi?", "İstanbul'da hava nasıl?", "Model çalışmazsa ne yapmalıyım?",
        "Adım Ayşe Nur Demir, e-postam ayse@okul.test, dilimi İngilizce yapın.", "Ad Soyad: Can Öz\nTitanic projesini seçtim, devam etmek istiyorum.", "Son tarih uzatabilir miyiz?", "Numaram 0532 111 22 33, listede adım yok.",
        "Her şey hazır: github repo, demo video, readme; e-posta ile gönderdim.", "Mehmet Kaya", "Video yok. Kaynak kod var ancak readme henüz değil", "kaydım için belge lazım", "Local RAG projesi nedir?",
    )
]

MARKERS = [("a [1] b [2] c [3]", 2), ("[0] ve [10] ve [x]", 9), ("yok", 0), ("[1][2]", 1)]
