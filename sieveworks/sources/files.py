"""Files of any file system that Spark's Hadoop layer knows: listed, read, written and moved by the driver, names and small texts only."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_file(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_folder(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def entries(folder: str, recursive: bool = False) -> list[str]:
    """Files of a folder, sorted, written as the folder was: with a scheme where it has one."""
    fs, p = _at(folder)
    if recursive:
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            out.append(found.next().getPath())
    else:
        out = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    return sorted(x.toString() if ":" in folder.split("/", 1)[0] else x.toUri().getPath() for x in out)


def folders(folder: str) -> list[str]:
    """Names of the folders in a folder, sorted."""
    fs, p = _at(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def write_text(path: str, text: str) -> None:
    fs, p = _at(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def move(source: str, target: str) -> None:
    fs, p = _at(source)
    if not fs.rename(p, _at(target)[1]):
        raise OSError(f"{source} can't be moved to {target}")


def remove(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)
