"""Command line: server, query, status, documents."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from latewing.api import Engine
from latewing.config import Config, cache_folder, load
from latewing.operators.encoding import ENCODERS
from latewing.session import for_scoring


def parse(arguments: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="latewing")
    commands = parser.add_subparsers(dest="command")
    for name in ("server", "query", "status", "documents"):
        command = commands.add_parser(name)
        if name == "server":
            command.add_argument("--host", help="default: that of the configuration")
            command.add_argument("--port", "-p", type=int, help="default: that of the configuration")
        if name == "query":
            command.add_argument("text")
            command.add_argument("--top-k", "-k", type=int, help="default: that of the configuration")
            command.add_argument("--api-key", "-g")
            command.add_argument("--model")
            command.add_argument("--save-images", "-i", metavar="FOLDER", help="write the pages found to this folder")
            command.add_argument("--verbose", "-v", action="store_true")
        if name != "query":
            command.add_argument("path", nargs="?", help="configuration")
        command.add_argument("--config", "-c", help="default: config.yaml")
    known = {"server", "query", "status", "documents", "-h", "--help"}
    if not arguments or arguments[0] not in known:
        arguments = ["server", *arguments]  # a bare configuration, or nothing, starts the server
    options = parser.parse_args(arguments)
    options.config = options.config or getattr(options, "path", None) or "config.yaml"
    return options


def settings(options: argparse.Namespace) -> Config:
    """The configuration with what the command line says otherwise."""
    given = {"host": "host", "port": "port", "top_k": "top_k", "api_key": "answer_api_key", "model": "answer_model"}
    said = {into: getattr(options, name) for name, into in given.items() if getattr(options, name, None) is not None}
    return replace(load(options.config), **said)


def main(arguments: list[str], spark: SparkSession, codebook) -> None:
    options = parse(arguments)
    logging.basicConfig(level=logging.DEBUG if getattr(options, "verbose", False) else logging.INFO)
    config = settings(options)
    engine = Engine(spark, config, ENCODERS.get_for_model(config.base_model_id)(codebook))
    if options.command == "server":
        logging.info("%s:%s ingested %s", config.host, config.port, engine.start())
        engine.watch(f"{config.store or cache_folder()}/watch-checkpoint", every="5 seconds").awaitTermination()
    elif options.command == "query":
        for_scoring(spark)
        hits = engine.query(options.text, config.top_k)
        hits.show(truncate=False)
        if options.save_images:
            for i, hit in enumerate(hits.collect(), 1):
                engine.save_page(hit.file_path, hit.page_number, f"{options.save_images}/{i}-{hit.filename}-{hit.page_number}")
    else:
        (engine.status() if options.command == "status" else engine.documents()).show(truncate=False)
