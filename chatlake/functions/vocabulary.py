"""Word lists, patterns and texts that results depend on. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

# ------------------------------------------------------------------ fixed values: placeholders of masked data
EMAIL_MARK = "[E-POSTA]"
OFFICIAL_EMAIL_MARK = "[EĞİTMEN E-POSTA]"
PHONE_MARK = "[TELEFON]"
URL_MARK = "[ÖZEL LİNK]"
HANDLE_MARK = "[KULLANICI]"
ROSTER_MARK = "[KATILIMCI LİSTESİ GİZLENDİ]"

# ------------------------------------------------------------------ fixed values: hosts, domains, mentions
PRIVATE_HOSTS = ("teams.microsoft.com", "events.teams.microsoft.com", "msit.events.teams.microsoft.com", "1drv.ms", "onedrive.live.com", "sharepoint.com", "chat.whatsapp.com", "wa.me")
PUBLIC_HOSTS = ("learn.microsoft.com", "docs.microsoft.com", "github.com", "raw.githubusercontent.com", "huggingface.co", "pypi.org", "python.org", "streamlit.io")
DOCUMENTATION_DOMAINS = ("example.com", "example.org", "example.net", "example.edu")
OFFICIAL_DOMAINS = ("microsoft.com",)
KEPT_MENTIONS = ("eğitmen", "egitmen", "instructor", "microsoft", "everyone", "herkes")
AUTHORITY_ALIASES = ("eğitmen", "egitmen", "instructor")

# ------------------------------------------------------------------ fixed values: chat exports
BIDI = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2066, 0x2067, 0x2068, 0x2069, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E)))
SYSTEM_EVENTS = (
    "güvenlik kodu değişti", "security code changed", "bir grup bağlantısıyla katıldı", "joined using this group's invite link", "kişisini ekledi", "gruba ekledi", "added you",
    "gruptan ayrıldı", "left$", "çıkardı", "removed", "grubu oluşturdu", "created group", "grubun konusunu değiştirdi", "grup açıklamasını", "grubun simgesini", "changed the subject",
    "changed this group's icon", "telefon numarasını değiştirdi", "changed their phone number", "uçtan uca şifrelidir", "end-to-end encrypted", "dahil edilmedi", "omitted>?$",
    "bu mesaj silindi", "this message was deleted", "mesajı sildiniz", "null$",
)

# ------------------------------------------------------------------ fixed values: stop words
STOPWORDS = tuple(
    """acaba ama ancak artik asla aslinda az bana bazi bazen belki ben benim beri bile bir biraz birçok birkaç birşey biz bizim bu buna bunda bundan bunu bunun burada çok
    çünkü da daha de defa değil diye eğer en gibi hem hep hepsi her herhangi hiç için ile ise kez ki kim mi mı mu mü nasıl ne neden nerde nerede nereye niçin niye o olarak
    olduğu oldu olur onlar ona ondan onu onun oysa öyle sanki şey siz sizin şu şuna şunda şundan şunu tüm ve veya ya yani var yok""".split()
)

# ------------------------------------------------------------------ fixed values: topics of texts, in the order of precedence
CHUNK_TOPICS = {
    "technical": (
        "bağlanamıyor", "modele bağlan", "servisin ayakta", "endpoint", "base url", "execution provider", "download_and_register", "select_variant", "cuda", "gpu", "cpu üzerinde",
        "python sdk", "vektör veritaban", "embedding çıkar", "local rag mimari", "readme'ye kurulum", "readme’ye kurulum", "nasıl çalıştırılacağını", "model yüklü",
        "küçük modellerle başlayın", "foundry local kurdum", "foundry local çalışm",
    ),
    "submission": (
        "final teslim", "teslim eksik", "kaynak kod link", "video link", "e-mail atıyorsunuz", "e-posta ile gönder", "github'a yükleyebilirsiniz", "github’a yükleyebilirsiniz",
        "2 dakikada ne yaptığınızı", "2 dk max", "teslime_hazir", "zorunlu teslim",
    ),
    "correction": (
        "düzeltme istek", "düzeltme isteği", "düzeltmeler için", "düzeltmeleri anında", "ad-soyad ve listede", "whatsapp grubuna değil", "listede kayıtlı e-posta", "değiştirilebilen alanlar",
    ),
    "roster": (
        "isim listesi", "listeyi güncel", "liste gecikmeli", "çalışmaya devam", "çalışmayı durdur", "satırınızı kontrol", "satırınızı", "pinli liste", "listede adım", "listem güncellenmedi",
        "listede sertifika alanı", "github linkleri listede", "bu liste sadece benim takibim",
    ),
    "project": (
        "proje seçenek", "stock price prediction", "quantum kickstart", "titanic survival", "kendi projem", "disconnected bir ortamda", "yapay zekâya ulaşılabilirliği",
    ),
}
SOURCE_TOPICS = {"submission": ("submission", "teslim"), "correction": ("correction", "duzeltme", "düzeltme")}

# ------------------------------------------------------------------ fixed values: topics of questions, in the order of precedence
QUERY_TOPICS = {
    "roster": ("liste", "roster", "güncel değil", "guncel degil", "devam etmeli", "çalışmaya devam", "calismaya devam", "satırım", "satirim"),
    "correction": ("proje yanlış", "proje yanlis", "düzeltme", "duzeltme", "adım yanlış", "adim yanlis", "ismim", "güncellenmesini", "guncellenmesini"),
    "submission": (
        "teslim", "video çek", "video cek", "github repo", "github'a ne", "github’a ne", "ne koymam", "eksiğim", "eksigim", "kaynak kod", "yazmam yeterli", "whatsapp'tan yaz",
        "whatsapp’tan yaz", "whatsapp yeterli",
    ),
    "technical": ("çalışmazsa", "calismazsa", "çalışmıyor", "calismiyor", "bağlanamıyor", "baglanamiyor", "endpoint", "gpu", "cuda", "kurulum", "local rag"),
}
PROGRAMME = (
    "staj", "program", "eğitmen", "egitmen", "sertifika", "certificate", "proje", "video", "github", "repo", "kaynak kod", "source code", "foundry", "local rag", "rag", "model", "python",
    "duyuru", "grup", "mentor", "e-posta", "eposta", "e-mail", "whatsapp", "hazır", "hazir", "bitirdim", "tamamladım", "tamamladim", "çekmedim", "cekmedim", "yükledim", "yukledim",
    "gönderdim", "gonderdim", "eksik",
)
CATEGORIES = ("technical", "submission", "correction", "roster", "project", "general")
ALLOWED = {
    "roster": ("roster", "correction", "submission", "general"), "correction": ("correction", "roster", "submission"), "submission": ("submission", "correction"),
    "technical": ("technical", "project", "general", "submission"), "project": CATEGORIES, "general": CATEGORIES,
}

# ------------------------------------------------------------------ fixed values: modes
QA, CHECKLIST, CORRECTION, TECHNICAL = "instructor_qa", "submission_checklist", "correction_analyzer", "technical_help"
MODE_WORDS = {
    CORRECTION: ("listede", "satırım", "yanlış görünüyor", "düzeltme", "güncellenmesini", "devam etmek"),
    CHECKLIST: (
        "eksiğim", "teslim için", "hazır mıyım", "çekmedim", "repo hazır", "teslim durumu", "tesliminde", "final teslim", "ne koymam", "github'a ne", "github’a ne", "yazmam yeterli",
        "whatsapp'tan", "whatsapp’tan",
    ),
    TECHNICAL: ("hata", "error", "çalışmıyor", "kurulum", "python", "cuda", "gpu", "endpoint", "port"),
}
REQUIREMENT_WORDS = ("ne gerekiyor", "neler gerekiyor", "ne gerekli", "neler gerekli", "ne lazım", "zorunlu teslim", "tesliminde", "final teslim")
STATUS_WORDS = ("çekmedim", "eksiğim", "hazır mıyım", "repo hazır", "attım", "gönderdim", "teslim durumu")
CONTENTS_WORDS = ("ne koymam", "ne koymalıyım", "neler koymalıyım", "ne yüklemeliyim", "içine ne", "github'a ne", "github’a ne")
CODE_WORDS = ("github", "kaynak kod", "source code")
CHANNEL_WORDS = ("yeterli", "yeter mi", "yazmam", "yazsam", "gruba yaz", "whatsapp'tan", "whatsapp’tan")

# ------------------------------------------------------------------ fixed values: submission checklist (key, label, words, required, next step)
CHECKLIST_ITEMS = (
    ("source_code_link", "Kaynak kod linki (GitHub tercih ediliyor)", ("github", "repo", "kaynak kod", "source", "gitlab", "kod linki", "public link"), True,
     "Projeyi GitHub'da public bir repoya yükle ve linkini hazırla."),
    ("demo_video", "Kısa demo videosu (~2 dakika: ne yaptım / ne öğrendim)", ("video", "demo", "ekran kaydı", "kayıt aldım", "youtube", "loom", "tanıtım"), True,
     "2 dakikayı geçmeyen bir video çek: ne yaptığını ve ne öğrendiğini anlat, sonra videoyu erişilebilir bir yere yükle."),
    ("email_submission", "Linklerin e-posta ile eğitmene gönderilmesi", ("mail", "e-mail", "eposta", "e-posta", "gönderdim", "ilettim", "attım"), True,
     "Kod linkini ve video linkini ayrı ayrı tek bir e-postada eğitmene gönder."),
    ("readme", "README / proje açıklaması", ("readme", "açıklama", "dokümantasyon", "döküman", "belge"), False,
     "README'ye kurulum adımlarını, mimariyi ve demo sorularını ekle."),
)
NOT_MENTIONED = " — mesajında belirtilmemiş"
STEP_COMPLETE = "Teslim tamam görünüyor: e-postanı gönderdiysen listede satırının güncellenmesini bekle."
STEP_INCOMPLETE = "Eksikleri tamamladıktan sonra tüm linkleri tek e-postada gönder."
SUBMISSION_RULES = (
    "GitHub / kaynak kod linki gerekir (public bir link de kabul edilir).", "README / proje açıklaması önerilir (zorunlu değil).",
    "Kısa demo videosu gerekir: ne yaptım, ne öğrendim (yaklaşık 2 dakika).", "Kod ve video linkleri e-posta ile gönderilmelidir.", "Video yoksa teslim eksik sayılır.",
    "WhatsApp mesajı tek başına teslim yerine geçmez.",
)
CHANNEL_RULES = (
    "Hayır, WhatsApp tek başına yeterli değil.", "Teslim ve düzeltme istekleri e-posta ile gönderilmelidir.", "Düzeltme isteklerinde ad-soyad ve e-posta açık yazılmalıdır.",
    "Teslimde GitHub/source code ve video linkleri e-posta ile gönderilmelidir.",
)
SUBMISSION_TITLE, CHANNEL_TITLE = "**Final teslim için gerekenler**", "**WhatsApp teslim veya düzeltme yerine geçmez**"

# ------------------------------------------------------------------ fixed values: correction requests
PROJECTS = (
    ("Building Your First Local RAG Application with Foundry Local", ("foundry", "rag", "local rag", "foundry local")),
    ("Stock Price Prediction with PyTorch", ("pytorch", "stock", "hisse", "fiyat tahmin")),
    ("Quantum Kickstart with Q#", ("quantum", "kuantum", "q#", "qsharp")),
    ("Titanic Survival Analysis", ("titanic",)),
    ("Kendi projem", ("kendi projem", "kendi proje")),
)
LANGUAGES = (("Türkçe", ("türkçe", "turkce", "turkish")), ("English", ("ingilizce", "english", "ingilzce")))
STATUSES = (
    ("Devam etmek istemiyorum", ("devam etmek istemiyorum", "devam etmeyeceğim", "bırakmak istiyorum")),
    ("Devam etmek istiyorum", ("devam etmek istiyorum", "devam edeceğim", "devam ediyorum")),
)
LIST_WORDS = ("liste", "satır", "kayıt", "tablo", "dosyada", "görünüyor", "gözüküyor")
NAME_WORDS = ("ad", "isim", "soyad", "yazım")
NOT_NAMES = ("listede", "projem", "merhaba", "teşekkürler")
EMAIL_GIVEN = "mesajda belirtilmiş"
ADVICE_MISSING = (
    "Düzeltme isteğini eğitmene e-posta olarak gönder ve eksik bilgileri ekle: ",
    ". WhatsApp mesajı tek başına yeterli değil; eğitmen listedeki doğru satırı ancak ad-soyad ve e-posta ile eşleştirebiliyor.",
)
ADVICE_CLEAR = "İstek net görünüyor. Aynı bilgileri e-posta olarak eğitmene gönder; düzeltmeler toplu olarak ve insan kontrolüyle uygulanıyor."

# ------------------------------------------------------------------ fixed values: triage
CERTIFICATE_WORDS = ("sertifika", "certificate")
SENSITIVE = (
    ("sertifika", "sertifika"), ("certificate", "sertifika"), ("son tarih", "tarih/son teslim"), ("deadline", "tarih/son teslim"), ("uzatma", "tarih/son teslim"),
    ("uzatabilir", "tarih/son teslim"), ("tarih değiş", "tarih/son teslim"), ("tarihimi", "tarih/son teslim"), ("belge", "resmi belge"), ("evrak", "resmi belge"), ("imza", "resmi belge"),
    ("kaşe", "resmi belge"), ("transkript", "resmi belge"), ("staj formu", "resmi belge"), ("kaydım", "kişisel kayıt"),
)
INTENT_MODES = {
    "submission_requirement": CHECKLIST, "submission_channel": CHECKLIST, "correction_request": CORRECTION, "technical_help": TECHNICAL, "roster_continue": QA, "certificate": QA, "unknown": QA,
}
REDIRECT = "Kaynaklarda karşılık yok; soruyu eğitmene yönlendir."
REASONS = {
    "correction": "Düzeltme isteği: listeyi yalnızca eğitmen güncelleyebilir, taslak onay bekler.",
    "sensitive": ("Hassas konu (", "): yanlış cevabın geri alınması zor, insan onayı gerekir."),
    "personal": "Mesaj kişisel veri içeriyor; yanıtı bir insan kontrol etmeli.",
    "card": "Cevap kural kartından geliyor ama kaynak eşleşmesi zayıf; insan doğrulaması gerekir.",
    "weak": "Kanıt zayıf; ",
    "draft": "Kaynaklar soruyu karşılıyor; taslak kopyalanmaya hazır, göndermeyi insan yapar.",
}

# ------------------------------------------------------------------ fixed values: answers
NO_EVIDENCE = (
    "Bu soru yüklü kaynaklarda yer almıyor.\n\nStaj programı, teslim, liste düzeltme veya teknik kurulumla ilgili bir soru sorabilirsiniz.\n\n"
    "_Konu kaynaklarda net değil; uydurma bilgi vermemek için cevap üretmiyorum._"
)
BLANK_QUESTION = "Lütfen bir soru veya durum yaz."
LOW_CAVEAT = "Bu konu kaynaklarda net değil.\n\n"
UNCLEAR = "kaynaklarda net değil"
ACTION_WORDS = ("edin", "atın", "gönderin", "kontrol edin", "yükleyin", "koyun", "çalıştırın", "emin olun", "bekleyin", "ekleyin", "yazın", "seçin", "devam edin")
WEAK_STEMS = ("gerek", "olmal", "lazım", "nedir", "nasil", "nasıl")
ANECDOTE = r"^[\"“]|→|çekmedim|yapmadım|atmadım|repom hazır|durdurayım"
COVERAGE_WORDS = ("github", "source", "kaynak kod", "video", "e-posta", "e-mail", "whatsapp")
SECTIONS = ("Kısa cevap:\n", "\n\nNe yapmalısın:\n", "\n\nKaynaklara göre kanıt:\n", "\n\nKaynaklar:\n")
NO_SENTENCE = (
    "Kısa cevap:\nKaynaklarda bu soruya doğrudan karşılık gelen bir cümle bulamadım.\n\nNe yapmalısın:\n- Aşağıdaki kaynak parçalarını kendin inceleyebilirsin.\n\n"
    "Kaynaklara göre kanıt:\n- Kaynaklarda doğrudan alıntılanacak bir cümle yok.\n\nKaynaklar:\n"
)
NOTE_TITLE = "\n\n**Kaynaklara göre not**\n"
NO_RULE_SOURCE = "\n\n_Not: İndekste bu kuralları içeren kaynak bulunamadı; yukarıdaki maddeler program kurallarından türetilmiştir._"
LOW_RULE_NOTE = "\n\n_Bu konu kaynaklarda net değil; kurallar program özetinden, notlar ise en yakın eşleşmelerden üretildi._"
MISSING_LABELS = {"full_name": "ad-soyad", "email": "e-posta", "requested_change": "istenen değişiklik"}
NOTHING_MISSING = "yok, istek eksiksiz görünüyor"
CORRECTION_DOUBT = "Kaynaklarda bu düzeltme kuralı net değil. "
CORRECTION_CARD = (
    "**Bu bir düzeltme isteği**\n- Asistan listeyi değiştiremez; düzeltme otomatik olarak uygulanmaz.\n- Değişikliği yalnızca eğitmen yapabilir, yani insan onayı gerekir.\n"
    "- İsteği e-posta ile gönder; WhatsApp mesajı tek başına yeterli değil.\n- Eksik bilgi: ",
    "\n\n**Yapılandırılmış çıktı**\n```json\n", "\n```\n\n**E-posta taslağı (gönderilmedi, sadece öneri)**\n```\n", "\n```",
)
CHECKLIST_TEXT = {
    "ready": "**Hazır olanlar**\n", "none_ready": "- (henüz yok)", "missing": "\n\n**Eksikler**\n", "none_missing": "- Zorunlu bir eksik görünmüyor.",
    "unknown": "\n\n**Mesajından anlaşılmayanlar**\n", "steps": "\n\n**Önerilen sonraki adımlar**\n",
}
EMAIL_NAME, EMAIL_ADDRESSES = "<Ad Soyad>", ("<kayıtlı e-posta adresin>", "<e-posta adresin>")
EMAIL_DRAFT = (
    "Konu: Summer School listesi düzeltme isteği\n\nMerhaba Hocam,\n\nListedeki kaydımın güncellenmesini rica ediyorum. Ad Soyad: ", ", E-posta: ", "\n\nTeşekkür ederim,\n",
)
EMAIL_LINES = (("Proje", "project"), ("Dil", "language"), ("Devam durumu", "status"))
