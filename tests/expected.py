"""What the text operators must give, stated in plain Python for random inputs."""

import itertools
import re

SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2003\u2028\u205f\u3000"
END = tuple(".!?:ๆ।") + ("ครับ", "ค่ะ", "นะคะ", "นะครับ")
START = re.compile(r"[-*•#>] |[0-9].*\. ", re.S)


def cleanup(text):
    lines = [line.strip(SPACE) for line in text.split("\n")]
    paragraphs = []
    for filled, group in itertools.groupby(lines, key=bool):
        if not filled:
            continue
        tidy = [
            line
            if sum(1 for cell in line.split("  ") if cell.strip(SPACE)) > 2
            else " ".join(line.split())
            for line in group
        ]
        text_of = tidy[0]
        for previous, line in itertools.pairwise(tidy):
            text_of += ("\n" if previous.endswith(END) or START.match(line) else " ") + line
        paragraphs.append(text_of)
    return "\n\n".join(paragraphs)


def is_table(text):
    lines = [line.strip(SPACE) for line in text.split("\n")]
    lines = [line for line in lines if line]
    if len(lines) < 3:
        return False
    wide = [line for line in lines if len(re.findall("[ \t]{2,}", line)) >= 2]
    if len(wide) / len(lines) >= 0.4:
        return True
    words = [len(line.split()) for line in lines]
    steady = [min(a, b) >= 3 and abs(a - b) <= 2 for a, b in itertools.pairwise(words)]
    return any(flag and len(list(run)) >= 5 for flag, run in itertools.groupby(steady))


def file_lines(text):
    lines = re.split(r"\r?\n", text)
    return lines[:-1] if lines[-1] == "" else lines


def without_pages(text, gone):
    out, page = "", None
    for line in file_lines(text):
        header = re.fullmatch(r"## Page \s*([0-9]+)", line.strip(SPACE))
        page = int(header[1]) if header else page
        out += "" if page in gone else line + "\n"
    return out


def without_images(text, gone):
    kept, skipping = [], False
    for line in file_lines(text):
        bare = line.strip(SPACE)
        tag = re.search(r"\[IMAGE:([^\]]*)\]", line)
        if tag and tag[1] in gone:
            skipping = True
        elif skipping and bare == "":
            skipping = False
        elif not skipping or bare.startswith(("[IMAGE:", "#", "---")):
            skipping = False
            kept.append(line)
    return "\n".join(kept)
