"""Recall on a held-out set: names that no list of the detector holds in full, and the other kinds, in sentences that the
detector's patterns were not written from."""

import itertools

from sizelake.llm import personal_data as P

# names whose family or given name is in none of the lists
VIETNAMESE = ["Giàng Seo Phử", "Vừ Mí Dế", "Rơ Châm Tuấn", "Điểu Krông", "Bế Thị Sương", "Ma Seo Lử", "Ung Hoàng Phúc", "Cấn Thị Thêu", "Khúc Thừa Dụ", "Nhữ Đình Toản", "Lèng Văn Páo", "Đàm Khắc Vĩ", "Tòng Thị Ún", "Hà Vạn Lợi", "Vi Kiến Thành"]
FOREIGN = ["Aoife Brennan", "Lars Müller", "François Dupont", "Ingrid Solberg", "Tomasz Nowak", "Siobhan O'Neill", "Oluwaseun Adeyemi", "Bjarne Holm", "Katalin Varga", "Dmitri Volkov", "Rosalind Ashby-Cole", "Enzo Ferri", "Yara Haddad", "Nikhil Banerjee", "Zeynep Demir"]
FRAMES = ["Kính gửi ông {}, số liệu đã xong.", "sáng nay chị {} đã trao đổi", "Trân trọng. Người lập: {}", "Please call {} before noon.", "Reviewed by {}, approved.", "gặp anh {} ở tầng 3", "Dear {}, the sizing is attached.", "Mr {} was informed"]
# given and family name are in wide use: no cue is needed
BARE = ["John Smith", "Maria Garcia", "Wei Zhang", "Sùng A Páo", "Nguyễn Thị Út", "Trần Văn Chót", "nguyen van an", "phạm thị hoa", "Chen Wei", "Emily Watson-Hughes"]
OTHER = {
    "email": ["an@mail [ dot ] vidu.vn", "an@mail{ dot }vidu.vn", "an@mail<dot>vidu.vn", "an { at } mail ( chấm ) vn", "jane@domain。com", "le.an a còng vidu chấm vn", "a.b+c@sub.example.co.uk", "an (at) vidu (dot) vn", "AN@VIDU.VN", "an @ vidu.vn"],
    "phone": ["+1 415 555 2671", "+44 20 7946 0958", "(415) 555-2671", "0912 345 678", "0084 912 345 678", "+84 (0) 912 345 678", "khong bay sau ba hai mot nam bon sau hai", "oh three five six two one four five six seven", "không, chín, năm, sáu, bảy, tám, một, hai, ba, bốn", "０９１２３４５６７８"],
    "id_number": ["CCCD: {001093012345}", "số căn cước {001 093 012 345}", "hộ chiếu {B1234567}", "SSN {123-45-6789}", "cccd {không không một không chín ba không một hai ba bốn năm}", "passport no. {C7654321}", "CMND {012345678}", "identity card {079123456789}", "định danh cá nhân {0790 1234 5678}", "cmt so {123456789}"],
    "address": ["12 Nguyễn Trãi, P. Bến Thành, Quận Một Đông, TP. Hồ Chí Minh", "45/3 ngõ 12 phố Hàng Bài, Hà Nội", "7B đường Lý Thái Tổ, Hà Nội", "221 Baker Street, London", "1600 Ocean Avenue, Santa Monica", "3 Hai Ba Trung, quan Hoan Kiem, TP. Ha Noi", "88, phố Huế - quận Hai Bà - Hà Nội", "10 Elm Road, Springfield", "9bis hẻm 4 đường Trần Phú, TP. Đà Lạt", "56 Queen Lane, Port Stanley"],
}


def recall(cases):
    """cases: (text, kind, value) → share of cases whose value is found whole."""
    hits = [any(k == kind and v == value for k, _, _, v in P.findings(text)) for text, kind, value in cases]
    return sum(hits) / len(hits), [c for c, h in zip(cases, hits, strict=True) if not h]


def test_names_outside_the_lists():
    known = P._FAMILY | P._GIVEN
    assert sum(n.split()[0].lower() in known for n in VIETNAMESE + FOREIGN) <= 2
    got, missed = recall([(f.format(n), "name", n) for n, f in itertools.product(VIETNAMESE + FOREIGN, FRAMES)])
    assert got >= 0.9, (got, missed)


def test_names_without_cue():
    got, missed = recall([(f"hôm qua {n} nộp bảng số liệu", "name", n) for n in BARE])
    assert got >= 0.9, (got, missed)


def test_other_kinds():
    for kind, values in OTHER.items():
        cases = [(v.replace("{", "").replace("}", "") if kind == "id_number" else f"ở {v}, nhé", kind, v[v.index("{") + 1 : v.index("}")] if kind == "id_number" else v) for v in values]
        got, missed = recall(cases)
        assert got >= 0.9, (kind, got, missed)


def test_gates_are_implied_by_the_patterns():
    """Wherever a pattern matches, the test before it holds: over all disguises, spacings and brackets."""
    for o, c in ("[]", "()", "{}", "<>"):
        for s1, s2 in itertools.product(("", " ", "  ", "\t", "\n"), repeat=2):
            for w in ("at", "AT", "a còng", "A CONG", "@"):
                t = f"an{s1}{o}{s2}{w}{s1}{c}{s2}vidu"
                assert not P._AT.search(t) or P._NEEDS_AT.search(t), t
                assert P._AT.search(t), t
            for w in ("dot", "DOT", "chấm", "cham", "."):
                t = f"an{s1}{o}{s2}{w}{s1}{c}{s2}vidu"
                assert P._DOT.search(t) and P._NEEDS_DOT.search(t), t
    words = list(P.DIGITS)
    for i in range(len(words)):
        for gap in (" ", ", ", ".", "-", " - ", "/", "; ", "–", "\t"):
            t = "(" + gap.join(words[(i + k) % len(words)] for k in range(9)) + ")"
            assert P._SPELLED.search(t) and P._may_spell(t), t
            assert P.normalised(t).text == "(" + "".join(P.DIGITS[words[(i + k) % len(words)]] for k in range(9)) + ")"


def test_prose_is_left_alone():
    for t in ["phạm vi hệ thống mở rộng", "trần nhà máy chủ cao ba mét", "Data Center Manager approves Load Balancer sizing", "Mark the Storage Tier as done", "Server Room Two, Rack Nine", "hoàng hôn xuống, vũ trụ xa", "phiên bản 2.10.3.4500 ngày 12-05-2024", "John Smith Ltd giao máy"]:
        assert P.findings(t) == [], (t, P.findings(t))
