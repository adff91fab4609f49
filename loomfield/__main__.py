"""python -m loomfield clean FILE | journey FOLDER. Prints a JSON result; exit status 1 for an error."""

from __future__ import annotations

import json
import os
import sys

from loomfield.errors import EngineError, success


def main(args: list[str]) -> int:
    try:
        if len(args) != 2 or args[0] not in ("clean", "journey"):
            raise EngineError("INVALID_INPUT" if args else "INPUT_PATH_REQUIRED", __doc__.split(".")[0])
        from loomfield.session import session

        path = os.path.abspath(args[1])
        if args[0] == "clean":
            from loomfield.plans.publish import check_input, clean_workbook

            check_input(path)
            result = clean_workbook(session(), path, os.path.splitext(path)[0])
        else:
            from loomfield.plans import workflow

            rows, rejects = workflow.routed(session(), os.path.join(path, "Interview", "mapped-transcript*.md"))
            header = ["#", "Theme", "Question", "Response"]
            result = success(files=workflow.write_phase_files(session(), rows, header, os.path.join(path, "Journey Map")), rejected=[r.asDict() for r in rejects.collect()])
    except EngineError as e:
        print(json.dumps(e.envelope(), ensure_ascii=False))
        return 1
    except Exception as e:
        print(json.dumps(EngineError("INTERNAL_ERROR", f"{type(e).__name__}: {e}"[:500]).envelope(), ensure_ascii=False))
        return 1
    print(json.dumps(result, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
