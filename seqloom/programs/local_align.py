"""A program of its own, to be sent in an archive: ``local_align.py QUERIES DATABASE`` prints query, sequence and local score, tab-separated, of
each pair of records of two FASTA files.  It needs numpy, and waves.py beside it."""

import sys


def records(path: str):
    name, body = None, []
    for line in open(path):
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(body)
            name, body = line[1:].split()[0], []
        else:
            body.append(line.strip())
    if name is not None:
        yield name, "".join(body)


def main(queries: str, database: str, most: int = 2_000) -> None:
    from waves import scores

    q, held = list(records(queries)), []
    print("# query, sequence, score")

    def flush() -> None:
        found = scores([a for *_, a, _ in held], [b for *_, b in held], True, 10, -5, -5, -2)
        sys.stdout.writelines(f"{x}\t{y}\t{s}\n" for (x, y, *_), s in zip(held, found))
        held.clear()

    for y, b in records(database):
        for x, a in q:
            held.append((x, y, a, b))
            if len(held) >= most:
                flush()
    flush()


if __name__ == "__main__":
    main(*sys.argv[1:3])
